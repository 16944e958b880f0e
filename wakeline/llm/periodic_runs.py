"""Periodic runs of words: stretches that repeat themselves three times or more, found by maximal pairs.

Two places p < q of a text form a maximal pair of length l if the same l words
follow both, and neither the words before them nor the words after agree. If
their distance d = q - p is at most l / 2, the stretch from p to q + l has period
d, holds it three times at least and cannot be extended; and every such stretch
is a pair. So the runs are read off the maximal pairs whose distance fits their
length, and nothing has to be extended.

Maximal pairs come from the tree of LCP intervals over the suffix array, bottom
up. An interval holds the places that begin with its common words, in ascending
order, with the class of the word to the left of each; intervals are merged
small into large, and places of one left-word class are never a pair. Places of
an interval no more than half its length apart are steps of one period, so only
neighbours have to be looked at, and the work is n log n whatever the text.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.batches import slices, texts_of

LEAST = 24  # words of a run
TIMES = 3  # periods of a run


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of all texts, one after the other, and how many each text has. Words are parted by one space."""
    filled = [t for t in texts if t]
    if not filled:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    raw = b" ".join(filled) + b" "
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32) + 1
    bounds = np.cumsum(np.array([len(t) + 1 if t else 0 for t in texts]))
    counts = np.diff(np.searchsorted(ends, bounds, side="right"), prepend=0)
    edges = np.concatenate([[0], ends]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(edges), pa.py_buffer(raw)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), counts


def _named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each key among the distinct ones, and how often each distinct key occurs."""
    order = np.argsort(keys, kind="stable")
    new = np.append(True, np.diff(keys[order]) != 0)
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, np.diff(np.append(np.flatnonzero(new), len(keys)))


def _recurring(codes: np.ndarray, doc: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the texts in which some `length` (a power of two) words occur twice."""
    at = np.arange(len(codes))
    name = np.full(len(codes), -1, np.int64)
    keys, reach = doc * (int(codes.max()) + 1) + codes, 1
    while True:
        rank, counts = _named(keys)
        twice = counts[rank] > 1
        at = at[twice]
        if reach == length or not len(at):
            return np.unique(doc[at])
        name[:] = -1
        name[at] = rank[twice]
        at = at[at + 2 * reach <= ends[at]]
        at = at[name[at + reach] >= 0]
        if not len(at):
            return at
        keys = name[at] * len(codes) + name[at + reach]
        reach *= 2


def suffixes(codes: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of all texts, text by text, and the common words of each suffix with the one before (0 between texts)."""
    n = len(codes)
    rank, counts = _named(doc * (int(codes.max()) + 1) + codes)
    levels, reach, at = [rank], 1, np.arange(n)
    while len(counts) < n:
        beyond = at + reach
        inside = beyond < ends
        nxt = np.where(inside, rank[np.where(inside, beyond, 0)] + 1, 0)
        rank, counts = _named(rank * (n + 1) + nxt)
        levels.append(rank)
        reach *= 2
    order = np.empty(n, np.int64)
    order[rank] = at
    common = np.zeros(n, np.int64)
    pair = np.flatnonzero(doc[order[1:]] == doc[order[:-1]]) + 1
    a, b, got = order[pair - 1], order[pair], np.zeros(len(pair), np.int64)
    end = ends[a]
    for level in reversed(levels):
        x, y = a + got, b + got
        live = np.flatnonzero((x < end) & (y < end))
        live = live[level[x[live]] == level[y[live]]]
        got[live] += reach
        reach //= 2
    common[pair] = got
    return order, common


def maximal_pairs(places: list[int], common: list[int], left: list[int], least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(place, length, distance) of maximal pairs of a suffix array, for distances up to length / (times - 1).

    `common[i]` is the LCP with the suffix before, `left` the word before a
    place. A pair is found between neighbouring places when their intervals meet.
    """
    stack: list[list] = []  # depth, ascending places, the left word of all of them or None

    def meet(depth: int, one: tuple[list, object], other: tuple[list, object]) -> Iterator[tuple[int, int, int]]:
        large, small = (one, other) if len(one[0]) >= len(other[0]) else (other, one)
        (many, kind), (few, own) = large, small
        if kind is None or kind != own:
            for j, p in enumerate(few):
                i = bisect_left(many, p)
                if i and (not j or few[j - 1] < many[i - 1]):
                    d = p - many[i - 1]
                    if d * (times - 1) <= depth and d + depth >= least and left[p] != left[many[i - 1]]:
                        yield many[i - 1], d + depth, d
                if i < len(many) and (j + 1 == len(few) or few[j + 1] > many[i]):
                    d = many[i] - p
                    if d * (times - 1) <= depth and d + depth >= least and left[p] != left[many[i]]:
                        yield p, d + depth, d
            kind = None
        if 8 * len(few) < len(many):
            for p in few:
                insort(many, p)
        else:
            many += few
            many.sort()
        node[:] = [many, kind]

    common = [*common[1:], 0]
    for p, depth in zip(places, common):
        node = [[p], left[p]]
        while stack and stack[-1][0] > depth:
            d, held, kind = stack.pop()
            yield from meet(d, (held, kind), tuple(node))
        if stack and stack[-1][0] == depth:
            d, held, kind = stack.pop()
            yield from meet(d, (held, kind), tuple(node))
        if depth:
            stack.append([depth, *node])


def runs_of(texts: list[bytes], least: int = LEAST, times: int = TIMES) -> dict[int, list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text that has any, by start, then period. Words are parted by one space."""
    codes, counts = word_codes(texts)
    if not len(codes):
        return {}
    # A run has a pair of (times - 1) / times of its words at least.
    pair = -(-least * (times - 1) // times)
    doc = np.repeat(np.arange(len(texts)), counts)
    upto = np.cumsum(counts)
    some = _recurring(codes, doc, upto[doc], 1 << (pair.bit_length() - 1))
    if not len(some):
        return {}
    keep = np.isin(doc, some)
    codes, doc = codes[keep], doc[keep]
    begins = np.searchsorted(doc, some)
    number = np.repeat(np.arange(len(some)), np.diff(np.append(begins, len(doc))))
    ends = np.append(begins[1:], len(doc))[number]
    order, common = suffixes(codes, number, ends)
    common[common < pair] = 0
    near = np.flatnonzero((common > 0) | (np.append(common[1:], 0) > 0))
    left = np.append(-1, codes[:-1])
    left[begins] = -1
    found: dict[int, list] = {}
    first = begins[number].tolist()
    for p, length, period in maximal_pairs(order[near].tolist(), common[near].tolist(), left.tolist(), least, times):
        found.setdefault(int(doc[p]), []).append((p - first[p], length, period))
    return {d: sorted(r) for d, r in found.items()}


OUT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, *, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs and the text without repeats of every document: see OUT.

    A run is a stretch of `least` words or more that holds its smallest period
    `times` times at least and that no neighbouring word extends. Runs are in
    order of start, then period. `collapsed` joins the words that are in no run,
    or among the first period's words of every run they are in, by one space.
    Words are what ASCII white space parts. A null text has no words; each row
    is a document of its own, whatever its doc_id; an empty table gives no rows.
    """
    struct = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [b" ".join(t.encode().split()) for t in texts_of(batch)]
            counts = [t.count(b" ") + 1 if t else 0 for t in texts]
            runs = runs_of(texts, least, times)
            for i, found in runs.items():
                words = texts[i].split(b" ")
                gone = np.zeros(len(words), bool)
                for start, length, period in found:
                    gone[start + period : start + length] = True
                texts[i] = b" ".join([words[k] for k in np.flatnonzero(~gone).tolist()])
            rows = [[dict(zip(("start", "length", "period"), r)) for r in runs.get(i, ())] for i in range(len(texts))]
            collapsed = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(rows, struct), collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(find, OUT)


def looped(text: str = "text", doc_id: str = "doc_id") -> Column:
    """The text, in a tenth of the documents with its words from some place on replaced by repeats of the first of them.

    With h = crc32(doc_id) and g = h / 10: where h % 10 = 0, word i of n, from
    a = g % n on, is word a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8).
    """
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))) + 1
        at = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))
        return F.array_join(F.transform(at, lambda i: F.get(w, i.cast("int"))), " ")

    # The words are made once for each text that is changed, and for no other.
    held = F.when((h % 10 == 0) & (F.length(F.col(text)) > 0), F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeat(w)))[0])
    return F.coalesce(held, F.col(text))

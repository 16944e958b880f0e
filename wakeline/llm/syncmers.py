"""Document fingerprints from closed syncmers.

A k-mer of characters is chosen if the smallest (by hash) of its inner s-mers
is its first or its last. That depends on nothing outside the k-mer, so an edit
disturbs only anchors that overlap it, wherever it is; and every window of
k - s + 1 starts has one at least, so long shared passages always share anchors.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.batches import mix, slices
from wakeline.llm.ordering import RANGE, in_ranges, range_bounds, shuffle_width
from wakeline.llm.ordering import with_range

K, S = 32, 8
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        steps = np.full(size, BASE, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps)
        steps[1:] = INVERSE
        _inverses = np.cumprod(steps)


def _rolling(upto: np.ndarray, length: int) -> np.ndarray:
    """A hash of each substring of that length, from prefix sums modulo 2**64."""
    n = len(upto) - length
    return mix((upto[length:] - upto[:n]) * _inverses[:n])


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values, by doubling."""
    n, reach = len(values) - width + 1, 1
    while 2 * reach <= width:
        values = np.minimum(values[: len(values) - reach], values[reach:])
        reach *= 2
    return values[:n] if reach == width else np.minimum(values[:n], values[width - reach : width - reach + n])


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """24-bit hashes and positions of the closed syncmers, in text order.

    A text shorter than k is one anchor at 0; one with no closed syncmer has the
    k-mer with the smallest inner hash; an empty one has none.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    _grow(n + 1)
    upto = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(codes) * _powers[:n], out=upto[1:])
    if n < k:
        return (_rolling(upto, n) >> np.uint64(40)).astype(np.uint32), np.zeros(1, np.int64)
    inner = _rolling(upto, s)
    width = k - s + 1
    least = _window_least(inner, width)
    at = np.flatnonzero((least == inner[: len(least)]) | (least == inner[width - 1 :]))
    if not len(at):  # only below 2k - s characters
        at = least.argmin(keepdims=True)
    return (mix((upto[at + k] - upto[at]) * _inverses[at]) >> np.uint64(40)).astype(np.uint32), at


def fingerprint(hashes: np.ndarray) -> str:
    """The anchors' hashes in text order, four base64 characters each."""
    return base64.b64encode(hashes.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Anchors that both have (as often as both have them), over the mean number; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return float(2 * np.minimum(nx[i], ny[j]).sum() / (len(a) + len(b)))


def shift(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int | None:
    """How far the passages of b mostly lie after those of a: the commonest difference of first positions of equal anchors."""
    x, i = np.unique(a[0], return_index=True)
    y, j = np.unique(b[0], return_index=True)
    _, p, q = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(p):
        return None
    offsets, counts = np.unique(b[1][j[q]] - a[1][i[p]], return_counts=True)
    return int(offsets[counts.argmax()])


def edited(text: str, following: str) -> str:
    """The last quarter of the text replaced by as much of the following text's start."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


class _Marked:
    """A document with its anchors."""

    __slots__ = ("hashes", "key", "text")

    def __init__(self, key: int | None, text: str):
        self.key, self.text, self.hashes = key, text, anchors(text)[0]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc: _Marked, following: _Marked) -> tuple:
    new = edited(doc.text, following.text)
    marks = anchors(new)[0]
    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return doc.key, len(doc.text), digest, fingerprint(doc.hashes), fingerprint(marks), likeness(doc.hashes, marks), likeness(doc.hashes, following.hashes)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are: see OUT.

    The edit takes text of the next document in ascending doc_id order (after
    the last, the first). Documents are dealt once, into ranges of doc_id that
    are streamed in order; only the first document of a range is sent to the
    range before it too. A null text is empty. Rows of one doc_id follow each
    other in the order of their texts; a row without doc_id is its own next one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = shuffle_width(docs.sparkSession)
    bounds = range_bounds(rows, "doc_id", ranges)
    ids = with_range(rows.filter("doc_id is not null").select("doc_id"), "doc_id", bounds)
    firsts = sorted((r[RANGE], r["first"]) for r in ids.groupBy(RANGE).agg(F.min("doc_id").alias("first")).collect())
    # Of each range's first id, the range before it. At most one for each range.
    before = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series, spread: pd.Series) -> pd.Series:
        """A row's range; for a first row also the one before, as -1 - range."""
        at = np.searchsorted(edges, keys.fillna(0).to_numpy(np.int64), side="right")
        out = []
        for key, missing, own, other in zip(keys.fillna(0).astype("int64"), keys.isna(), at.tolist(), spread):
            out.append([other] if missing else [own, -1 - before[key]] if key in before else [own])
        return pd.Series(out)

    dealt = rows.withColumn("_place", F.explode(places("doc_id", F.pmod(F.xxhash64("text"), F.lit(len(edges) + 1)).cast("int"))))
    dealt = dealt.withColumn(RANGE, F.when(F.col("_place") < 0, -1 - F.col("_place")).otherwise(F.col("_place"))).withColumn("_halo", F.col("_place") < 0)
    names = [c.split()[0] for c in OUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Marked | None = None
        for batch in slices(batches, "text"):
            out = []
            for key, text, halo in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_halo"))):
                if key is None:
                    out.append(_row(doc := _Marked(None, text), doc))
                elif held is not None or not halo:
                    doc = _Marked(key, text)
                    out += [_row(held, doc)] if held is not None else []
                    held = None if halo else doc
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], names)

    ordered = in_ranges(dealt, len(edges) + 1, "_halo", F.col("doc_id").asc_nulls_first(), "text")
    return ordered.select("doc_id", "text", "_halo").mapInArrow(stream, OUT)

"""Documents packed into training sequences by non-negative least squares over a histogram.

A document's ids are cut into whole windows and a rest shorter than one. Only
how many rests have each length decides the packing, so the plan is made from a
histogram of at most `window` numbers, however many documents there are:

1. enumerate all combinations of up to three lengths that fill a window exactly;
2. solve how often each is to be repeated, min |A x - h| with x >= 0;
3. round, never above what the histogram holds;
4. pack what is left greedily, longest first, and cut a rest where none fits;
   what such cuts leave over fills further windows side by side.

The plan says, for each length, which of its documents (by rank) go to which
sequences at which place. Ranks come from counts a block and are exact; no
group of equal lengths is ever sorted or collected.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from wakeline.llm.batches import slices
from wakeline.llm.byte_tokens import byte_encoder
from wakeline.llm.tokens import LOOKED_UP_BYTES, tokenizer_path
from wakeline.session import cut_lineage

WINDOW = 1024
END_ID = 0
ROUNDS = 400  # of the solver; what it leaves is packed greedily
CLOSE = 1e-3  # share of the histogram that the solver may leave unexplained
BATCH = 128  # combinations that step at once
PLAN = "class int, lo long, hi long, cut_from int, cut_length int, at long, stride long"


def combinations(window: int) -> np.ndarray:
    """All ascending pairs and triples of lengths from 1 that add up to the window; the first of a pair is 0."""
    pairs = np.arange(1, window // 2 + 1)
    found = [np.stack([np.zeros_like(pairs), pairs, window - pairs], 1)]
    for a in range(1, window // 3 + 1):
        b = np.arange(a, (window - a) // 2 + 1)
        found.append(np.stack([np.full_like(b, a), b, window - a - b], 1))
    return np.concatenate(found)


def least_squares(combos: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and repeats x >= 0 that nearly minimise |A x - h| (coordinate descent, many columns at a time).

    `h` holds how many rests have each length, from 0. Each round takes the
    combinations whose best step, up or down, most lowers the squared error and
    that have no length in common, so that their steps do not disturb each
    other. Few columns ever leave zero: a plan stays short.
    """
    left = h.astype(np.float64)
    left[0] = 0.0
    goal, x = CLOSE * left.sum(), np.zeros(len(combos))
    # |column|^2: equal lengths of a combination add up in one place.
    a, b, c = combos.T
    norm = (a > 0) + 2.0 + 2.0 * ((a == b) & (a > 0)) + 2.0 * (b == c) + 2.0 * ((a == c) & (a > 0))
    for _ in range(ROUNDS):
        if np.abs(left).sum() <= goal:
            break
        step = np.maximum(-x, (left[a] + left[b] + left[c]) / norm)
        worth = step * step * norm
        # A column that is in the solution comes before a new one of up to four times its worth.
        worth[x > 0] *= 4.0
        best = np.argpartition(-worth, min(len(worth) - 1, 32 * BATCH))[: 32 * BATCH]
        best = best[np.argsort(-worth[best], kind="stable")]
        used, take = bytearray(len(left)), []
        for i, lengths in zip(best.tolist(), combos[best].tolist()):
            if not any(used[n] for n in lengths if n):
                take.append(i)
                for n in lengths:
                    used[n] = 1
                if len(take) == BATCH:
                    break
        take = np.array(take)
        if not worth[take].max() > 1e-12:
            break
        x[take] += step[take]
        np.subtract.at(left, combos[take].ravel(), np.repeat(step[take], 3))
        left[0] = 0.0
    found = np.flatnonzero(x > 0)
    return combos[found], x[found]


def plan(h: np.ndarray, window: int = WINDOW) -> list[tuple]:
    """Rows of PLAN for a histogram of rests (index: length).

    All sequences lie end to end on one line of ids. Of the rests of length
    `class`, those of ranks lo .. hi - 1 lay their ids from `cut_from` on,
    `cut_length` of them, at `at`, `at + stride` and so on: a stride of a window
    gives each its place in sequences of one pattern, one of its own length lays
    them side by side. The number of rows depends on the lengths alone.
    """
    rows, sequence, loose = [], 0, []
    count = {n: int(c) for n, c in enumerate(h.tolist()) if n and c}
    lengths, taken = sorted(count), dict.fromkeys(count, 0)

    def lay(n: int, m: int, place: int, piece: int | None = None) -> None:
        """Rests of length n into the next m sequences, or their first `piece` ids; what these leave is loose."""
        lo, size = taken[n], piece or n
        rows.append((n, lo, lo + m, 0, size, sequence * window + place, window))
        if size < n:
            loose.append((n, lo, m, size))
        taken[n] += m
        count[n] -= m
        if not count[n]:
            lengths.pop(bisect_left(lengths, n))

    combos, x = least_squares(combinations(window), h)
    for i in np.argsort(-x, kind="stable").tolist():
        parts = [n for n in combos[i].tolist() if n]
        m = min(round(float(x[i])), *(count.get(n, 0) // parts.count(n) for n in parts))
        if m:
            place = 0
            for n in parts:
                lay(n, m, place)
                place += n
            sequence += m
    # Each turn uses up a length, or all but a few of it, and adds none.
    while lengths:
        slots, used, gap, cut = [], {}, window, None
        while gap:
            fits = bisect_left(lengths, gap + 1) - 1
            while fits >= 0 and used.get(lengths[fits], 0) >= count[lengths[fits]]:
                fits -= 1
            if fits < 0:
                longer = (n for n in lengths[bisect_left(lengths, gap) :] if used.get(n, 0) < count[n])
                if cut := next(longer, None):
                    used[cut] = used.get(cut, 0) + 1
                break
            n = lengths[fits]
            slots.append(n)
            used[n] = used.get(n, 0) + 1
            gap -= n
        if gap and not cut:
            break
        m = min(count[n] // k for n, k in used.items())
        place = 0
        for n in slots:
            lay(n, m, place)
            place += n
        if cut:
            lay(cut, m, place, gap)
        sequence += m
    at = sequence * window
    for n, lo, m, start in loose + [(n, taken[n], count[n], 0) for n in lengths]:
        rows.append((n, lo, lo + m, start, n - start, at, n - start))
        at += m * (n - start)
    return rows


def pieces(docs: DataFrame, *, window: int = WINDOW, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Whole windows and rests of every document, written once.

    doc_id, doc_tokens, start, length, ids (little-endian, `width` bytes each),
    width, ids_crc32, and `block` and `ordinal`, which number the pieces of a
    length: a block is what one task tokenised.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
    names = ["doc_id", "doc_tokens", "start", "length", "ids", "width", "ids_crc32", "block", "ordinal"]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block, seen = byte_encoder(path), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        width = 2 if max(words.size, end_id + 1) <= 1 << 16 else 4
        for batch in slices(batches, "text", LOOKED_UP_BYTES):
            ids, lengths = words.encode(batch.column("text"))
            ids, lengths = np.insert(ids, np.cumsum(lengths), end_id), lengths + 1
            per = -(-lengths // window)
            doc = np.repeat(np.arange(len(lengths)), per)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * window
            size = np.minimum(window, lengths[doc] - start)
            order = np.argsort(size, kind="stable")
            counts = np.bincount(size, minlength=window + 1)
            ordinal = np.empty(len(doc), np.int64)
            ordinal[order] = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen, counts)
            seen += counts
            edges = np.concatenate([[0], np.cumsum(size)])
            wide, here = memoryview(ids.astype("<u4").tobytes()), (4 * edges).tolist()
            crc = [zlib.crc32(wide[a:b]) for a, b in zip(here, here[1:])]
            flat = pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer((width * edges).astype(np.int32)), pa.py_buffer(ids.astype(f"<u{width}").tobytes())])
            own = batch.column("doc_id").take(pa.array(doc))
            columns = [own, lengths[doc], start, size, flat, np.full(len(doc), width), crc, np.full(len(doc), block), ordinal]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names)

    schema = "doc_id long, doc_tokens long, start long, length int, ids binary, width int, ids_crc32 long, block int, ordinal long"
    return cut_lineage(rows.mapInArrow(cut, schema))


@F.pandas_udf(LongType())
def _crc(ids: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([zlib.crc32(np.frombuffer(x, f"<u{w}").astype("<u4").tobytes()) for x, w in zip(ids, width)], dtype="int64")


def packed(docs: DataFrame, *, window: int = WINDOW, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document and its place in a sequence of at most `window` ids.

    doc_id, start (its document's ids before it), length, ids, width, ids_crc32,
    doc_tokens, sequence_id (from 0), offset (in the sequence). A null text is
    empty and has only the end id; an empty table gives no rows; rows of one
    doc_id, or without, are documents of their own. All sequences are full but
    the last few, whose lengths are powers of two. Results are those of the
    order in which Spark reads the table.
    """
    spark = docs.sparkSession
    found = pieces(docs, window=window, tokenizer=tokenizer, end_id=end_id)
    counts = cut_lineage(found.groupBy("length", "block").count())
    h = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most `window` rows
        h[r["length"]] = r["n"]
    rows, whole = plan(h[:window], window), int(h[window])
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = found.hint("merge").join(offsets, ["length", "block"]).withColumn("rank", F.col("before") + F.col("ordinal"))
    out = ["doc_id", "start", "length", "ids", "width", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    full = ranked.where(F.col("length") == window).select("*", F.col("rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).select(*out)
    # A few rows for each length: bounded by the window, whatever the size of the table.
    slots = F.broadcast(spark.createDataFrame(rows, PLAN))
    rest = ranked.where(F.col("length") < window)
    laid = rest.join(slots, (F.col("length") == F.col("class")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    begin = F.col("at") + (F.col("rank") - F.col("lo")) * F.col("stride")
    laid = laid.withColumn("begin", begin).withColumn("end", F.col("begin") + F.col("cut_length"))
    # Where sequences begin: at each window, and in what is left after the last one at powers of two.
    total = int((h[:window] * np.arange(window)).sum())
    tails = [total - total % window]
    while total - tails[-1]:
        tails.append(tails[-1] + (1 << ((total - tails[-1]).bit_length() - 1)))
    marks = F.array((F.floor(F.col("begin") / window) + 1) * window, *(F.lit(x) for x in tails))
    inner = F.array_sort(F.array_distinct(F.filter(marks, lambda x: (x > F.col("begin")) & (x < F.col("end")))))
    edges = F.concat(F.array("begin"), inner, F.array("end"))
    laid = laid.withColumn("edges", edges).select("*", F.posexplode(F.slice("edges", 1, F.size("edges") - 1)).alias("part", "from"))
    laid = laid.withColumn("size", F.element_at("edges", F.col("part") + 2) - F.col("from")).withColumn("skip", F.col("cut_from") + F.col("from") - F.col("begin"))
    first, number = F.floor(F.col("from") / window) * window, F.floor(F.col("from") / window)
    for i, x in enumerate(tails):
        first, number = F.when(F.col("from") >= x, F.lit(x)).otherwise(first), F.when(F.col("from") >= x, F.lit(tails[0] // window + i)).otherwise(number)
    put = laid.select(
        "doc_id", (F.col("start") + F.col("skip")).alias("start"), F.col("size").cast("int").alias("length"),
        F.expr("substring(ids, cast(skip * width + 1 as int), cast(size * width as int))").alias("ids"), "width", "doc_tokens",
        (F.lit(whole) + number).alias("sequence_id"), (F.col("from") - first).alias("offset"),
    )
    return full.unionByName(put.withColumn("ids_crc32", _crc("ids", "width")).select(*out))


def sequences(placed: DataFrame) -> DataFrame:
    """One row a sequence: sequence_id, ids of all its pieces in order, length, and the pieces (doc_id, start, length, offset).

    A sequence has no more pieces than ids, so its group is bounded by the window.
    """
    part = F.struct("offset", "doc_id", "start", "length", "ids", "width")
    grouped = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    return grouped.select(
        "sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), F.expr("p[0].width").alias("width"),
        F.expr("aggregate(p, 0, (a, x) -> a + x.length)").alias("length"),
        F.expr("transform(p, x -> struct(x.doc_id, x.start, x.length, x.offset))").alias("pieces"),
    )

"""Mix sources to target weights: pivotal dependent rounding of copy probabilities."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.batches import unused
from wakeline.session import cut_lineage

WEIGHTS = (3, 1, 2)  # of the sources in code point order, repeating
SHARE = 1.5  # what all targets together have of all words
MOST = 2  # copies of a document at most, and so a target's most over its source's size
BLOCK = 4096  # rows, or residuals, that one step of the reduction tree pairs up
SALTS = 64
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of runs of other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, n_rows, source_size, target: shares by weight, none above `most` times its source's size.

    A source's weight goes by its place in code point order, null last. With
    target = min(most * size, level * weight), the level rises until the targets
    add up; each step is a sum over sources and only scalars reach the driver.
    """
    grouped = sizes.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    placed = cut_lineage(grouped.sort(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, start = {}, 0
    for p, n in counts:  # a row for each partition of the sort
        before[p], start = start, start + n
    if not before:
        return placed.select("source", "n_rows", "source_size", F.lit(0.0).alias("target"))
    offset = F.element_at(F.create_map(*(F.lit(x).cast("long") for kv in before.items() for x in kv)), part)
    rank = offset + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (rank % len(weights) + 1).cast("int"))
    ranked = placed.withColumn("weight", weight)

    full = F.col("source_size") * most
    wanted = share * (ranked.agg(F.sum("source_size").alias("s")).first()["s"] or 0)
    level, known = 0.0, -1
    while True:
        above = F.col("weight") * level > full
        r = ranked.agg(F.sum(F.when(above, full).otherwise(0)).alias("full"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("free"), F.sum(above.cast("long")).alias("n")).first()
        if r["n"] == known or not r["free"]:
            break
        level, known = (wanted - r["full"]) / r["free"], r["n"]
    return ranked.select("source", "n_rows", "source_size", F.least(full.cast("double"), F.col("weight") * level).alias("target"))


def _pivotal(group: pd.DataFrame, seed: tuple[int, ...]) -> np.ndarray:
    """Round the chances `p` of rows of sizes `size`, keeping their sum of sizes, but for one that may stay fractional.

    Two fractional rows meet; mass goes from one to the other, size for size,
    until one of them is 0 or 1. The direction is drawn so that each keeps its
    expectation. The one still fractional meets the next row.
    """
    chance = np.random.Generator(np.random.PCG64(list(seed))).random(len(group)).tolist()
    p, w = group["p"].tolist(), group["size"].tolist()
    held = -1
    for i in range(len(p)):
        if p[i] <= 0.0 or p[i] >= 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b = p[held] * w[held], p[i] * w[i]  # masses
        room_a, room_b = w[held] - a, w[i] - b
        up, down = min(room_a, b), min(a, room_b)  # most that the held one can gain and give
        if chance[i] * (up + down) < down:
            full = up == room_a  # the held one is taken, else the new one is spent
            p[held], p[i] = (1.0, (b - up) / w[i]) if full else ((a + up) / w[held], 0.0)
        else:
            full = down == a  # the held one is spent, else the new one is taken
            p[held], p[i] = (0.0, (b + down) / w[i]) if full else ((a - down) / w[held], 1.0)
        held = i if full else held
        if not 0.0 < p[held] < 1.0:
            p[held] = round(p[held])
            held = -1
    return np.array(p, np.float64)


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 7) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken (copies * size).

    A document's expected copies are its source's target over its source's
    size. The whole part is certain; the fraction is rounded by the pivotal
    method inside blocks of about BLOCK rows dealt by a hash of doc_id, each of
    which leaves one fractional row at most; those meet in the next level of a
    reduction tree, until a source has one block. A source's taken words
    differ from its target by less than one document. Equal tables give equal
    results, however they are dealt to tasks. Documents of size 0 have the
    whole part only, as do all where nothing is left to round.
    """
    sizes = cut_lineage(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size_of(F.col("text")).alias("size")))
    targets = cut_lineage(source_targets(sizes, weights=weights, share=share, most=most))
    # A hot source is spread over salts on both sides.
    salted = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    key = F.xxhash64("doc_id", F.lit(seed))
    s = sizes.withColumn("key", key).withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).alias("s")
    t = salted.withColumnRenamed("source", "t_source").withColumnRenamed("salt", "t_salt").alias("t")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        s.join(t, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("salt") == F.col("t_salt")))
        .withColumn("rate", rate)
        .withColumn("whole", F.floor("rate"))
        .withColumn("p", F.when(F.col("size") > 0, F.col("rate") - F.col("whole")).otherwise(0.0))
        .withColumn("block", F.pmod(F.shiftright("key", 7), F.ceil(F.col("n_rows") / BLOCK)))
        .select("doc_id", "source", "size", "source_size", "target", "whole", "p", "key", "block")
    )
    blocks = math.ceil((targets.agg(F.max("n_rows").alias("n")).first()["n"] or 0) / BLOCK)
    schema, level, done = rows.schema, 0, None
    while True:
        # Whole rows need no partner and stay out of the grouping.
        settled = rows.filter("p <= 0 or p >= 1")
        met = rows.filter("p > 0 and p < 1").groupBy("source", "block").applyInPandas(_block_step(seed, level, last=blocks <= 1), schema)
        rows = cut_lineage(settled.unionByName(met))
        fractional = "p > 0 and p < 1"
        done = rows.filter(f"not ({fractional})") if done is None else done.unionByName(rows.filter(f"not ({fractional})"))
        if blocks <= 1:
            break
        rows = rows.filter(fractional).withColumn("block", F.floor(F.col("block") / BLOCK))
        blocks, level = math.ceil(blocks / BLOCK), level + 1
    copies = (F.col("whole") + F.col("p").cast("long")).cast("long")
    return done.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _block_step(seed: int, level: int, last: bool):
    def step(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "doc_id", "size"], kind="stable", ignore_index=True)
        source = [0] if key[0] is None else [1, *key[0].encode()]
        group["p"] = _pivotal(group, (seed, level, int(key[1]), *source))
        if last and len(left := group.index[(group["p"] > 0) & (group["p"] < 1)]):
            u = np.random.Generator(np.random.PCG64([seed, level, 99, *source])).random()
            group.loc[left, "p"] = float(u < group.loc[left[0], "p"])
        return group

    return step


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of `docs`.

    Rows that repeat a doc_id are all taken as often as the one taken most.
    """
    key, n, copy = (unused(docs.columns, c) for c in ("_mixed_id", "_copies", "_copy"))
    copies = mix(docs, **how).groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").cast("int").alias(n))
    taken = docs.join(copies, F.col("doc_id").cast("long").eqNullSafe(F.col(key))).filter(F.col(n) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)

"""Near duplicates: ProbMinHash signatures, banding, exact verification, connected groups.

The elements of a document are its different shingles of five words, all of
weight 1, since links are decided on the sets: weights by count would part
texts that repeat the same shingles a different number of times. Each runs a
Poisson process of its weight's rate, seeded by its hash; every arrival picks a
register, and a register keeps the element of its first arrival. Two documents
agree in a register with the probability Jaccard of their weighted sets, which
for equal weights is the Jaccard of the sets. An element stops when its next arrival is later than
every register's, so a long document costs little more than one pass over it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.batches import mix, slices, unused
from wakeline.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8  # Jaccard of the sets of shingles, from which on two texts are linked
BANDS, ROWS = 20, 6  # a pair of similarity 0.8 shares a band with a chance of 0.998
REGISTERS = BANDS * ROWS
CLOSE = 0.65  # share of equal registers below which a pair is not verified: 4 standard deviations below 0.8
BLOCK = 512  # members of a bucket, or queries, that one task compares at once
ODD = np.uint64(0x9E3779B97F4A7C15)
UNIT = 2.0**-53


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and how many each text has.

    Words are runs of letters and digits in lower case; a text without any has
    its runs of other than white space.
    """
    texts = pc.fill_null(texts, "")
    plain = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " "), " ")
    plain = pc.if_else(pc.equal(plain, ""), pc.utf8_trim(pc.replace_substring_regex(texts, r"\s+", " "), " "), plain)
    words = pc.split_pattern(plain, " ")
    counts = np.where(pc.equal(plain, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(words).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = words.flatten()
    coded = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return known[coded.indices.to_numpy(zero_copy_only=False)], counts


def shingles(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: text number, shingle hash and count of each different shingle, in this order.

    A text of fewer than five words is one shingle; one without words has none.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    longest = max(SHINGLE, 1)
    padded = np.concatenate([words, np.zeros(longest, np.uint64)])
    number = np.maximum(counts - SHINGLE + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), number)
    at = np.repeat(starts - (np.cumsum(number) - number), number) + np.arange(number.sum())
    used = np.minimum(counts, SHINGLE)[doc]
    g = np.zeros(len(doc), np.uint64)
    for k in range(SHINGLE):
        g = np.where(k < used, mix(g * ODD + padded[at + k] + np.uint64(k)), g)
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])])) if len(g) else np.zeros(0, np.int64)
    return doc[first], g[first], np.diff(np.append(first, len(g)))


def identities(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each text's sequence of words."""
    ends = np.cumsum(counts)
    place = np.arange(len(words)) - np.repeat(ends - counts, counts)
    out = np.empty((2, len(counts)), np.uint64)
    for k in range(2):
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words + mix(place.astype(np.uint64) * ODD + np.uint64(k))), dtype=np.uint64)])
        out[k] = mix(upto[ends] - upto[ends - counts] + counts.astype(np.uint64))
    return out.view(np.int64)


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """ProbMinHash of n weighted sets: 16 bits of the element in each register."""
    when = np.full(n * REGISTERS, np.inf)
    held = np.zeros(n * REGISTERS, np.uint16)
    latest = np.full(n, np.inf)
    value = (mix(element + np.uint64(77)) >> np.uint64(48)).astype(np.uint16)
    sums = np.zeros(len(doc))
    k = 0
    while len(doc):
        k += 1
        u = mix(element + np.uint64(k * int(ODD) % (1 << 64)))
        sums = sums - np.log1p(-(u >> np.uint64(11)).astype(np.float64) * UNIT)
        t = sums / weight
        going = t < latest[doc]
        doc, element, weight, value, sums, t, u = (x[going] for x in (doc, element, weight, value, sums, t, u))
        register = doc * REGISTERS + (mix(u + np.uint64(1)) % np.uint64(REGISTERS)).astype(np.int64)
        sooner = np.flatnonzero(t < when[register])
        sooner = sooner[np.argsort(-t[sooner], kind="stable")]  # of several for one register the earliest is written last
        when[register[sooner]], held[register[sooner]] = t[sooner], value[sooner]
        latest = when.reshape(n, REGISTERS).max(axis=1) if n else latest
        going = t < latest[doc]
        doc, element, weight, value, sums = (x[going] for x in (doc, element, weight, value, sums))
    return held.reshape(n, REGISTERS)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, e1, e2 (hashes of the words), signature (null for a text without words)."""

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, counts = word_hashes(batch.column("text"))
            doc, element, _ = shingles(words, counts)
            found = signatures(doc, element, np.ones(len(doc)), len(counts))
            e = identities(words, counts)
            marks = pa.array([row.tobytes() if n else None for row, n in zip(found, counts)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(e[0]), pa.array(e[1]), marks], ["doc_id", "e1", "e2", "signature"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(sketch, "doc_id long, e1 long, e2 long, signature binary")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """rep, shingles: the sorted 32-bit hashes of each text's shingles."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            doc, element, _ = shingles(*word_hashes(batch.column("text")))
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1)).tolist()
            short = (element >> np.uint64(32)).astype(np.uint32)
            sets = [np.unique(short[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.binary())], ["rep", "shingles"])

    return docs.select("rep", "text").mapInArrow(build, "rep long, shingles binary")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint32)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) whose sets of shingles have a Jaccard of SIMILARITY at least."""

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            keep = [jaccard(_set(p.as_buffer()), _set(q.as_buffer())) >= SIMILARITY for p, q in zip(x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, comp of every node with a link; comp is the smallest node of its component.

    Alternates two steps until nothing changes: each node ties its larger
    neighbours to its smallest neighbour, then its smaller ones too. Every step
    leaves at most as many links as there were, in a table of its own.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    edges = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    known = state(edges)
    while known["n"]:
        near = both(edges)
        least = cut_lineage(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(large.distinct())
        # Edges now point from a node to a smaller one.
        least = cut_lineage(edges.groupBy("a").agg(F.min("b").alias("m")))
        small = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        edges = cut_lineage(small.distinct())
        before, known = known, state(edges)
        if known == before:
            break
    pointed = edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return pointed.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _across(members: DataFrame, comps: DataFrame, sets: DataFrame, marks: DataFrame) -> DataFrame:
    """Links between members of a bucket that are still in different components.

    In each bucket, the members outside its commonest component are queries
    against all its members; both sides are dealt in blocks. A pair is looked at
    in the first band that it shares, and verified from the sets at hand, until
    the query is tied to that component.
    """
    placed = members.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    placed = cut_lineage(placed.select("band", "bucket", "rep", "comp"))
    sizes = placed.groupBy("band", "bucket", "comp").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("band", "bucket").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
    mixed = cut_lineage(mixed.filter("comps > 1").drop("comps"))
    rows = placed.join(mixed, ["band", "bucket"]).withColumn("asks", F.col("comp") != F.col("main"))
    blocks, asked = F.ceil(F.col("n") / BLOCK), F.ceil((F.col("n") - F.col("most")) / BLOCK)
    own, own_asked = F.pmod(F.xxhash64("rep"), blocks), F.pmod(F.xxhash64("rep", F.lit(1)), asked)
    heavy = sets.join(marks, "rep")
    rows = rows.select("band", "bucket", "rep", "comp", "asks", own.alias("own"), own_asked.alias("own_asked"), blocks.alias("blocks"), asked.alias("asked"))
    told = rows.select("band", "bucket", "rep", "comp", F.lit(False).alias("asks"), F.col("own").alias("block"), F.explode(F.sequence(F.lit(0), F.col("asked").cast("long") - 1)).alias("part"))
    asks = rows.filter("asks").select("band", "bucket", "rep", "comp", "asks", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("long") - 1)).alias("block"), F.col("own_asked").alias("part"))
    dealt = told.unionByName(asks).join(heavy, "rep")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        band = int(group["band"].iloc[0])
        them, us = (group[group["asks"] == x] for x in (False, True))
        marks = np.frombuffer(b"".join(them["signature"]), np.uint16).reshape(-1, REGISTERS)
        reps, comps, sets = them["rep"].to_numpy(), them["comp"].to_numpy(), [_set(s) for s in them["shingles"]]
        out = []
        for rep, comp, mark, own in zip(us["rep"], us["comp"], us["signature"], us["shingles"]):
            same = marks == np.frombuffer(mark, np.uint16)
            first = same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
            likely = same.mean(axis=1)
            tied, own = {comp}, _set(own)
            for i in sorted(np.flatnonzero((comps != comp) & (first == band) & (likely >= CLOSE)).tolist(), key=lambda i: -likely[i]):
                if comps[i] not in tied and jaccard(own, sets[i]) >= SIMILARITY:
                    tied.add(comps[i])
                    out.append((rep, reps[i]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return dealt.groupBy("band", "bucket", "block", "part").applyInPandas(compare, "a long, b long")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, group_id (smallest doc_id of its group), duplicate: one row for each row of `docs`.

    Documents with the same words are one group whatever their length, those
    without words (null too) among them. Different texts are linked if they
    share a band, agree in CLOSE of their registers and have a Jaccard of
    SIMILARITY, and groups are the components of links. Rows that share a
    doc_id are in one group. A row without doc_id is in the group of its words,
    and has no group where no row of them has a doc_id.
    """
    sketched = cut_lineage(sketches(docs))
    known = sketched.filter("doc_id is not null")
    classes = cut_lineage(known.groupBy("e1", "e2").agg(F.min("doc_id").alias("rep"), F.max("signature").alias("signature")))
    marks = classes.filter("signature is not null").select("rep", "signature")

    # Buckets of two representatives at least.
    bands = F.array(*(F.xxhash64(F.lit(b), F.substring("signature", 2 * ROWS * b + 1, 2 * ROWS)) for b in range(BANDS)))
    dealt = marks.select("rep", F.posexplode(bands).alias("band", "bucket"))
    shared = cut_lineage(dealt.groupBy("band", "bucket").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).filter("centre < last").drop("last"))
    # Both sides of these two joins grow with the corpus: a merge at every size, never a broadcast of what happens to be small.
    members = cut_lineage(dealt.join(shared.hint("merge"), ["band", "bucket"]))

    live = members.select("rep").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(live.hint("merge"), "rep", "left_semi")
    sets = cut_lineage(shingle_sets(texts))

    # First, each member and the bucket centre that it meets most often.
    met = members.filter("rep <> centre").groupBy("rep", "centre").agg(F.count("*").alias("n"))
    best = met.groupBy(F.col("rep").alias("a")).agg(F.max_by("centre", F.struct("n", -F.col("centre"))).alias("b"))
    links = cut_lineage(verified(best, sets).distinct())
    # Then all that are still apart within a bucket.
    across = cut_lineage(_across(members.select("band", "bucket", "rep"), components(links), sets, marks))
    comps = components(links.unionByName(across))

    named = classes.select("e1", "e2", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    named = cut_lineage(named.select("e1", "e2", F.coalesce("comp", "rep").alias("group_id")))
    found = sketched.select("doc_id", "e1", "e2").join(named, ["e1", "e2"], "left")
    return found.select("doc_id", "group_id", F.coalesce(F.col("doc_id") != F.col("group_id"), F.col("group_id").isNotNull()).alias("duplicate"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group: the one with the smallest doc_id, once, in the order of texts where rows repeat it.

    Rows without a doc_id are not compared with each other and all stay.
    """
    key, nth = (unused(docs.columns, c) for c in ("_kept_id", "_nth"))
    kept = groups(docs).filter("not duplicate and doc_id is not null").select(F.col("doc_id").alias(key)).distinct()
    one = docs.filter("doc_id is not null").join(kept, F.col("doc_id").cast("long") == F.col(key), "left_semi")
    one = one.withColumn(nth, F.row_number().over(Window.partitionBy(F.col("doc_id").cast("long")).orderBy("text")))
    return one.filter(F.col(nth) == 1).drop(nth).unionByName(docs.filter("doc_id is null"))

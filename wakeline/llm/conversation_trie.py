"""The prefix tree of conversations: which beginnings they share, and what storing those once saves.

Conversations are sequences of turns. Ordered by the digests of their turns,
they are dealt into ranges, so all that begin alike are neighbours, and each
range builds a Z-fast trie of its own: compacted nodes, hashed by their prefix
of two-fattest depth, so that a conversation finds where it leaves the tree in
a binary search over its depths. Edges are then expanded into a node a turn.

Only a beginning of a range's first or last conversation can have members in
another range. Such open nodes are few (a conversation's depth, twice a range);
they are merged by hash and their subtrees summed along those paths. All other
nodes are final where they were made and are not moved again. Texts are hashed
where they are read; from there a turn is 16 bytes and a length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.ordering import RANGE, range_bounds, shuffle_width, with_range
from wakeline.session import cut_lineage

NOBODY = hashlib.sha256(b"").hexdigest()
RANGE_TURNS = 200_000  # of a range: what one task holds as a tree
CHUNK = 50_000  # conversations of an id range, of which at most all are equal and listed in one row
BYTES = 16  # of a turn's digest


def conversations(turns: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, turns (digest of role and text as hexadecimal text, code points of the text) in order of turn.

    A null turn comes first, equal ones are ordered by digest; a null role or
    text is empty. Rows without conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256), 1, 2 * BYTES)
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), digest.alias("digest"), F.length(text).alias("chars"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", F.expr("transform(t, x -> struct(x.digest, x.chars))").alias("turns"))


def shared_starts(convs: DataFrame, *, every: int = 100, turns: int = 6) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of c - c % every, h = crc32(c) % turns."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % turns).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, turns - 1).alias("head"))
    joined = convs.withColumn("base", base).join(heads, "base", "left").withColumn("h", h)
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0)), own).alias("turns"))


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that is a multiple of the highest power of two."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class ZFastTrie:
    """Compacted prefix tree of digest sequences.

    Node i has the prefix of length `extent[i]` of `prefixes[i]`, the hashes of
    all prefixes of a sequence that made it. `handle` finds it by the hash at
    the two-fattest depth of its edge, `branch` by that of its edge's first turn.
    """

    def __init__(self) -> None:
        root = [hashlib.md5().digest()]
        self.extent, self.parent = [0], [0]
        self.prefixes, self.chars = [root], [[]]
        self.count, self.least, self.ends = [0], [None], [NOBODY]
        self.handle, self.branch = {root[0]: 0}, {}

    def exit(self, prefixes: list[bytes]) -> tuple[int, int]:
        """The node on whose edge, or at whose end, a sequence leaves the tree, and how many turns it has in common."""
        low, high, node = 0, len(prefixes) - 1, 0
        size = high
        while low < high:
            at = two_fattest(low, high)
            found = self.handle.get(prefixes[at])
            if found is None:
                high = at - 1
                continue
            end, node = self.extent[found], found
            if end > size or self.prefixes[found][end] != prefixes[end]:
                return found, self._common(found, prefixes, at)
            low = end
        if low < size and (below := self.branch.get(prefixes[low + 1])) is not None:
            return below, self._common(below, prefixes, low + 1)
        return node, low

    def _common(self, node: int, prefixes: list[bytes], low: int) -> int:
        """The greatest depth, from `low` on, to which the node's sequence and this one agree."""
        own, high = self.prefixes[node], min(self.extent[node], len(prefixes) - 1)
        while low < high:
            middle = (low + high + 1) // 2
            if own[middle] == prefixes[middle]:
                low = middle
            else:
                high = middle - 1
        return low

    def _node(self, extent: int, parent: int, prefixes: list[bytes], chars: list[int]) -> int:
        self.extent.append(extent)
        self.parent.append(parent)
        self.prefixes.append(prefixes)
        self.chars.append(chars)
        self.count.append(0)
        self.least.append(None)
        self.ends.append(NOBODY)
        return len(self.extent) - 1

    def _hang(self, node: int) -> None:
        """Enter a node under its handle and its edge's first turn."""
        above, own = self.extent[self.parent[node]], self.prefixes[node]
        self.handle[own[two_fattest(above, self.extent[node])]] = node
        self.branch[own[above + 1]] = node

    def insert(self, batch: Iterable[tuple[list[bytes], list[int], int, int, str]]) -> None:
        """Add sequences: hashes of all prefixes, code points of the turns, how many conversations, the least of them, the digest of all."""
        for prefixes, chars, count, least, ends in batch:
            node, common = self.exit(prefixes)
            size = len(prefixes) - 1
            if common < self.extent[node]:  # the edge is cut in two
                above = self.parent[node]
                del self.handle[self.prefixes[node][two_fattest(self.extent[above], self.extent[node])]]
                middle = self._node(common, above, self.prefixes[node], self.chars[node])
                self.parent[node] = middle
                self._hang(middle)
                self._hang(node)
                node = middle
            if common < size:
                node = self._node(size, node, prefixes, chars)
                self._hang(node)
            self.count[node] += count
            self.least[node] = least if self.least[node] is None else min(self.least[node], least)
            self.ends[node] = ends

    def end_of(self, prefixes: list[bytes]) -> int:
        return self.exit(prefixes)[0]

    def expanded(self, paths: list[list[bytes]]) -> Iterator[tuple]:
        """A row of NODES for each turn of each edge; nodes on `paths` (whole sequences of this tree) are open."""
        n = len(self.extent)
        on: list[list[int]] = [[] for _ in range(n)]
        for side, prefixes in enumerate(paths):
            node = self.end_of(prefixes)
            while node:
                on[node].append(side)
                node = self.parent[node]
            on[0].append(side)
        total, least, children = self.count[:], self.least[:], [0] * n
        closed, leaves, saved = [0] * n, [0] * n, [0] * n
        deepest_first = sorted(range(1, n), key=self.extent.__getitem__, reverse=True)
        for node in [*deepest_first, 0]:
            if not on[node]:
                leaves[node] = leaves[node] or 1
            saved[node] += (total[node] - 1) * self._width(node) if not on[node] else 0
            if node:
                above = self.parent[node]
                total[above] += total[node]
                least[above] = least[node] if least[above] is None else min(least[above], least[node])
                children[above] += 1
                if not on[node]:
                    closed[above] += 1
                    leaves[above] += leaves[node]
                    saved[above] += saved[node]
        for node in range(n):
            own, chars, end = self.prefixes[node], self.chars[node], self.extent[node]
            above = self.extent[self.parent[node]] if node else -1
            gain = saved[node]
            for depth in range(above + 1, end + 1):
                last = depth == end
                size = chars[depth - 1] if depth else 0
                before = own[depth - 1] if depth else None
                ends = self.ends[node] if last else NOBODY
                if not on[node]:
                    up = None if depth == above + 1 and on[self.parent[node]] else before if depth else None
                    first = least[node] if depth > above + 1 else least[self.parent[node]]
                    yield None, own[depth], before if up is None else None, depth, size, total[node], least[node], first if up is not None else None, children[node] if last else 1, leaves[node], gain, ends
                    gain -= (total[node] - 1) * size
                else:
                    # Numbers stand in the row of one path; open children are counted when all ranges are known.
                    yield on[node][0], own[depth], before, depth, size, total[node], least[node], None, closed[node] if last else 0, leaves[node] if last else 0, saved[node] if last else 0, ends
                    for side in on[node][1:]:
                        yield side, own[depth], before, depth, size, 0, None, None, 0, 0, 0, NOBODY

    def _width(self, node: int) -> int:
        """Code points of all turns of a node's edge."""
        return sum(self.chars[node][self.extent[self.parent[node]] : self.extent[node]]) if node else 0


NODES = [
    ("path", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary()), ("depth", pa.int64()), ("chars", pa.int64()), ("n", pa.int64()),
    ("least", pa.int64()), ("parent_least", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string()),
]
NODES_DDL = "path long, key binary, parent_key binary, depth long, chars long, n long, least long, parent_least long, children long, leaves long, saved long, ends string"


def prefix_hashes(path: bytes) -> list[bytes]:
    """Hashes of the first 0, 1, .. turns of a sequence of digests."""
    state = hashlib.md5()
    out = [state.digest()]
    for a in range(0, len(path), BYTES):
        state.update(path[a : a + BYTES])
        out.append(state.digest())
    return out


def _distinct(convs: DataFrame) -> DataFrame:
    """Equal conversations as one row: path, chars, n, least, ends (digest of all their ids in order).

    Ids are listed by range of ids first, so that thousands or millions of
    copies are a few rows when they meet; their digest is taken as a stream.
    """
    spark = convs.sparkSession
    digests = F.unhex(F.array_join(F.transform("turns", lambda x: x["digest"]), ""))
    rows = cut_lineage(convs.select("conv_id", digests.alias("path"), F.transform("turns", lambda x: x["chars"]).alias("chars")))
    rows = with_range(rows, "conv_id", range_bounds(rows, "conv_id", -(-rows.count() // CHUNK))).withColumn("key", F.md5("path"))
    listed = rows.groupBy("key", RANGE).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"), F.count("*").alias("n"), F.min("conv_id").alias("least"),
        F.first("path").alias("path"), F.first("chars").alias("chars"),
    )
    kinds = [("path", pa.binary()), ("chars", pa.list_(pa.int32())), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())]

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None  # the row under way and the digest of its ids so far
        for batch in batches:
            out = []
            for key, ids, n, least, path, chars in zip(*(batch.column(c).to_pylist() for c in ("key", "ids", "n", "least", "path", "chars"))):
                if held is not None and held[0] == key:
                    held[3] += n
                    state.update(b",")
                else:
                    out += [(*held[1:], state.hexdigest())] if held is not None else []
                    held, state = [key, path, chars, n, least], hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield _batch(out, kinds)
        if held is not None:
            yield _batch([(*held[1:], state.hexdigest())], kinds)

    dealt = listed.repartition(shuffle_width(spark), "key").sortWithinPartitions("key", RANGE).select("key", "ids", "n", "least", "path", "chars")
    return dealt.mapInArrow(joined, "path binary, chars array<int>, n long, least long, ends string")


def _batch(rows: list[tuple], kinds: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*rows), kinds)], [name for name, _ in kinds])


def _nodes(distinct: DataFrame) -> DataFrame:
    """Rows of NODES of all ranges."""
    rows = cut_lineage(distinct)
    turns = rows.agg(F.sum(F.size("chars")).alias("t")).first()["t"] or 0
    ranges = max(shuffle_width(rows.sparkSession), -(-turns // RANGE_TURNS))

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, first, last, part = ZFastTrie(), None, None, TaskContext.get().partitionId()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("path", "chars", "n", "least", "ends")]
            if paths := columns[0]:
                first, last = min([*paths, first] if first is not None else paths), max([*paths, last] if last is not None else paths)
                trie.insert(zip(map(prefix_hashes, paths), *columns[1:]))
        if first is None:
            return
        out = []
        for row in trie.expanded([prefix_hashes(first), prefix_hashes(last)]):
            out.append(row if row[0] is None else (2 * part + row[0], *row[1:]))
            if len(out) == 8192:
                yield _batch(out, NODES)
                out = []
        if out:
            yield _batch(out, NODES)

    dealt = rows.repartitionByRange(ranges, "path")
    return cut_lineage(dealt.mapInArrow(build, NODES_DDL))


def conversation_trie(convs: DataFrame) -> DataFrame:
    """Every node of the prefix tree of conversations (conv_id, turns; see `conversations`).

    conv_id (least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and key, the hash of the node's turns.
    A conversation without turns is a member of the root alone; without any
    conversation there is no root.
    """
    nodes = _nodes(_distinct(convs))
    final = ["key", "depth", "n", "least", "parent_least", "children", "leaves", "saved", "ends"]
    closed, opened = nodes.where("path is null"), nodes.where("path is not null")
    merged = opened.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.sum("n").alias("n"), F.min("least").alias("least"),
        F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.min("path").alias("owner"),
        F.max(F.when(F.col("ends") != NOBODY, F.col("ends"))).alias("ends"),
    )
    merged = cut_lineage(merged)
    below = merged.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("open_children"))
    whole = merged.join(below, "key", "left").withColumn("children", F.col("children") + F.coalesce("open_children", F.lit(0)))
    # What a node has beside its open children; each stands on one of its paths, and is summed upwards along it.
    own = whole.select(
        "key", "owner", (F.col("leaves") + (F.col("children") == 0).cast("long")).alias("own_leaves"), (F.col("saved") + (F.col("n") - 1) * F.col("chars")).alias("own_saved"),
    )
    there = F.col("path") == F.col("owner")
    upwards = Window.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    along = opened.select("path", "key", "depth").join(own, "key").select("path", "key", "depth", *(F.when(there, F.col(c)).otherwise(0).alias(c) for c in ("own_leaves", "own_saved")))
    sums = along.select("key", F.sum("own_leaves").over(upwards).alias("l"), F.sum("own_saved").over(upwards).alias("s")).groupBy("key").agg(F.sum("l").alias("leaves"), F.sum("s").alias("saved"))
    parents = merged.select(F.col("key").alias("parent_key"), F.col("least").alias("above"))
    known = whole.drop("leaves", "saved").join(sums, "key").join(parents, "parent_key", "left").withColumn("parent_least", F.col("above"))
    known = known.withColumn("ends", F.coalesce("ends", F.lit(NOBODY)))
    hung = closed.where("parent_key is not null").join(parents, "parent_key").withColumn("parent_least", F.col("above"))
    rest = closed.where("parent_key is null")
    every = known.select(final).unionByName(hung.select(final)).unionByName(rest.select(final))
    return every.select(
        F.col("least").alias("conv_id"), "depth", F.col("parent_least").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"), "key",
    )

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from wakeline.llm import conversation_trie as ct
from wakeline.llm.registered import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    """Turns of each conversation by the contract, from (conv_id, turn, role, text) rows."""
    own = {}
    for conv_id, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own.setdefault(conv_id, []).append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute(convs):
    """All nodes by their prefixes, from {conv_id: turns}."""
    members, ends = {}, {}
    for c, turns in convs.items():
        ends.setdefault(tuple(turns), []).append(c)
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = leaves.get(p, 0) or 1
        saved[p] = saved.get(p, 0) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        if p:
            up = p[:-1]
            children[up] = children.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[p]
            saved[up] = saved.get(up, 0) + saved[p]
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], digest(p)) for p, m in members.items()), key=repr)


def found(nodes):
    return sorted(map(tuple, nodes.select(*COLUMNS).collect()), key=repr)


def asked(turns, tmp_path):
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    return found(QUERIES["op13_conversation_trie"](turns.sparkSession, str(tmp_path)))


def test_whole_table(spark, sf, tmp_path):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    assert found(QUERIES["op13_conversation_trie"](spark, sf)) == brute(rebuilt([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]))


def _turns(seed, n=700):
    """Conversations with common beginnings, many copies, one of them a third of all."""
    rng = random.Random(seed)
    hot = [("user", "hello"), ("assistant", "how can I help?"), ("user", "é \U0001f600")]
    rows = []
    for c in rng.sample(range(0, 4000), n) + [0, 100, 200]:
        if rng.random() < 0.33:
            turns = hot
        else:
            turns = [(rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ccc"])) for _ in range(rng.randint(1, 9))]
            turns = hot[: rng.randint(0, 3)] + turns
        rows += [(c, t, *x) for t, x in enumerate(turns)]
    seen = {}
    for r in rows:
        seen[r[0], r[1]] = r
    return list(seen.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_copies_and_common_beginnings(spark, tmp_path, seed, monkeypatch):
    rows = _turns(seed)
    monkeypatch.setattr(ct, "CHUNK", 50)
    monkeypatch.setattr(ct, "RANGE_TURNS", 60)
    random.Random(seed).shuffle(rows)
    assert asked(spark.createDataFrame(rows, SCHEMA), tmp_path) == brute(rebuilt(rows))


def test_odd_rows(spark, tmp_path):
    long = "word " * 100_000
    rows = [
        (1, None, "user", "first"), (1, 0, None, None), (1, 1, "user", ""), (2, 0, "", ""), (3, 5, "user", long), (3, 6, "assistant", long), (4, 5, "user", long),
        (None, 0, "user", "nobody's"), (None, None, None, None), (5, 0, "user:", "x"), (6, 0, "user", ":x"), (7, 0, "us", "erx"), (1000, 0, "user", "no base"),
        *((8, t, "user", "again") for t in range(300)), *((9, t, "user", "again") for t in range(200)), (-150, 0, "user", "below zero"),
    ]
    turns = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("key", "path", "n", "depth", "turns", "base", "_range", "h")})
    convs = ct.conversations(turns)
    expected = {}
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        expected.setdefault(c, []).append((role or "", text or ""))
    assert found(ct.conversation_trie(convs)) == brute(expected)


def test_turnless_conversations_are_members_of_the_root(spark):
    turn = "array<struct<digest:string,chars:int>>"
    convs = spark.createDataFrame([(1, []), (2, []), (3, [("0" * 32, 4)])], f"conv_id long, turns {turn}")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found(ct.conversation_trie(convs)) == sorted([(1, 0, None, 3, 1, 1, 0, digest("1,2")), (3, 1, 1, 1, 0, 1, 0, digest("3"))], key=repr)


def test_empty_table(spark, tmp_path):
    assert asked(spark.createDataFrame([], SCHEMA), tmp_path) == []


def test_two_fattest():
    for low in range(40):
        for high in range(low + 1, 41):
            assert ct.two_fattest(low, high) == max(range(low + 1, high + 1), key=lambda x: x & -x)


@pytest.mark.parametrize("seed", range(5))
def test_fat_binary_search_finds_the_exit(seed):
    rng = random.Random(seed)
    trie, held = ct.ZFastTrie(), []
    for _ in range(300):
        path = b"".join(bytes([rng.randint(0, 1)]) * ct.BYTES for _ in range(rng.choice([3, 10, 60])))
        if held and rng.random() < 0.7:
            other = rng.choice(held)
            path = other[: ct.BYTES * rng.randint(0, len(other) // ct.BYTES)] + path
        prefixes = ct.prefix_hashes(path)
        node, common = trie.exit(prefixes)
        longest = max((sum(1 for k in range(0, min(len(path), len(o)), ct.BYTES) if path[: k + ct.BYTES] == o[: k + ct.BYTES]) for o in held), default=0)
        assert common == longest
        assert trie.extent[trie.parent[node]] < common <= trie.extent[node] or (node, common) == (0, 0)
        if path not in held:
            held.append(path)
            trie.insert([(prefixes, [1] * (len(prefixes) - 1), 1, len(held), "x")])
    assert sum(trie.count) == len(held)

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from wakeline.llm import near_duplicates as nd


def sets(texts):
    words = [[w for w in "".join(c.lower() if c.isalnum() else " " for c in t or "").split()] or (t or "").split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words], [tuple(w) for w in words]


def brute(rows):
    """Group of each doc_id: equal words, or a Jaccard of 0.8, and all that follows from it."""
    rows = [r for r in rows if r[0] is not None]
    shingles, words = sets([r[1] for r in rows])
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(shingles[i] & shingles[j])
            if rows[i][0] == rows[j][0] or words[i] == words[j] or both and both >= 0.8 * (len(shingles[i]) + len(shingles[j]) - both):
                parent[root(i)] = root(j)
    least = defaultdict(lambda: 1 << 62)
    for i, r in enumerate(rows):
        least[root(i)] = min(least[root(i)], r[0])
    return {r[0]: least[root(i)] for i, r in enumerate(rows)}


def got(docs):
    return {r["doc_id"]: r["group_id"] for r in nd.groups(docs).collect() if r["doc_id"] is not None}


def test_whole_table(documents):
    assert got(documents) == brute([(r["doc_id"], r["text"]) for r in documents.collect()])


def chains(n=160):
    """Copies of copies: each differs from the one before by a few words, so ends of a chain are far apart."""
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, text = [], rnd.choices(vocabulary, k=200)
    for i in range(n):
        if i % 40 == 0:
            text = rnd.choices(vocabulary, k=200)
        text = list(text)
        text[rnd.randrange(200)] = rnd.choice(vocabulary)
        rows.append((1000 - i, " ".join(text)))
    return rows


def test_chains_of_copies(make):
    rows = chains()
    want = brute(rows)
    assert len(set(want.values())) == 4
    assert got(make(rows)) == want


def test_blocks_of_a_hot_bucket(make, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 3)
    rows = chains(80)
    assert got(make(rows)) == brute(rows)


def test_odd_rows(make, odd_rows):
    docs = make(odd_rows, clashing=True)
    assert got(docs) == brute(odd_rows)
    assert nd.groups(docs).count() == len(odd_rows)
    kept = nd.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(brute(odd_rows).values()))
    assert kept.filter("doc_id is null").count() == 2


def test_empty_table(make):
    assert nd.groups(make([])).count() == 0


@pytest.mark.parametrize("share", [0.5, 0.8, 0.95])
def test_registers_estimate_probability_jaccard(share):
    rng = np.random.default_rng(int(share * 100))
    common = int(400 * share)
    x = {int(e): float(w) for e, w in zip(rng.integers(0, 2**63, 400), rng.integers(1, 6, 400))}
    y = dict(list(x.items())[:common]) | {int(e): float(w) for e, w in zip(rng.integers(0, 2**63, 400 - common), rng.integers(1, 6, 400 - common))}
    keys = set(x) & set(y)
    exact = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in set(x) | set(y)) for d in keys)
    hits = []
    for seed in range(8):
        elements = np.array([*x, *y], np.uint64) ^ nd.mix(np.full(800, seed, np.uint64))
        marks = nd.signatures(np.repeat([0, 1], 400), elements, np.array([*x.values(), *y.values()]), 2)
        hits.append((marks[0] == marks[1]).mean())
    assert abs(np.mean(hits) - exact) < 0.05


def test_early_termination_changes_nothing():
    """Registers equal those of a process that runs every element far past all first arrivals."""
    rng = np.random.default_rng(4)
    element, weight = rng.integers(0, 2**63, 50).astype(np.uint64), rng.integers(1, 4, 50).astype(float)
    best = {}
    for e, w in zip(element, weight):
        total = 0.0
        for k in range(1, 400):
            u = nd.mix(np.array([(int(e) + k * int(nd.ODD)) % (1 << 64)], np.uint64))
            total -= float(np.log1p(-(u >> np.uint64(11)).astype(np.float64) * nd.UNIT)[0])
            r = int(nd.mix(u + np.uint64(1))[0] % np.uint64(nd.REGISTERS))
            if r not in best or total / w < best[r][0]:
                best[r] = (total / w, int(nd.mix(np.array([e], np.uint64) + np.uint64(77))[0] >> np.uint64(48)))
    assert nd.signatures(np.zeros(50, np.int64), element, weight, 1)[0].tolist() == [best[r][1] for r in range(nd.REGISTERS)]


def test_shingles_by_definition():
    texts = ["a b c d e f a b c d e", "One, two!", "", None, "?? !!", "x " * 50]
    doc, _, count = nd.shingles(*nd.word_hashes(pa.array(texts)))
    want, _ = sets(texts)
    assert np.bincount(doc, minlength=6).tolist() == [len(s) for s in want]
    assert count[doc == 0].tolist().count(2) == 1 and count[doc == 5].tolist() == [46]


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 7), (300, 2), (2, 299), (8, 8)]
    found = {r["node"]: r["comp"] for r in nd.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, 5: 5, 7: 5, 9: 5, 300: 2, 299: 2, 2: 2}


def unequal_counts(n=40):
    """Pairs of one set of shingles each but for a few, a quarter of which only one text repeats dozens of times."""
    rnd = random.Random(21)
    rows = []
    for i in range(n):
        # Every line is a paragraph of its own words: repeating it adds the four shingles across its seam, once.
        lines = [[f"p{i}l{k}w{j}" for j in range(12)] for k in range(40)]
        once = [w for line in lines for w in line]
        again = [w for k, line in enumerate(lines) for w in line * (60 if k < 10 else 1)]
        again[-rnd.randrange(1, 100)] = "other"
        rows += [(2 * i, " ".join(once)), (2 * i + 1, " ".join(again))]
    return rows


def test_repeats_do_not_part_equal_sets(make):
    rows = unequal_counts()
    want = brute(rows)
    assert set(want.values()) == {2 * i for i in range(40)}
    assert got(make(rows)) == want

from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from wakeline.llm import mixing


def levels(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by raising the level until they add up, source by source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        level = (total - sum(most * sizes[s] for s in capped)) / max(1, sum(w[s] for s in w if s not in capped))
        more = {s for s in w if s not in capped and w[s] * level > most * sizes[s]}
        if not more:
            return {s: float(most * sizes[s]) if s in capped else w[s] * level for s in w}
        capped |= more


def test_targets_and_taken_words(spark, documents):
    got = mixing.mix(documents).toPandas()
    texts = documents.toPandas()
    size = {d: len((t or "").split()) for d, t in zip(texts.doc_id, texts.text)}
    assert dict(zip(got.doc_id, got["size"])) == size
    sums = texts.assign(size=texts.doc_id.map(size)).groupby("source", dropna=False)["size"].sum().to_dict()
    want = levels(sums)
    assert got.target.to_dict() == pytest.approx({i: want[s] for i, s in got.source.items()})
    assert (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    for source, rows in got.groupby("source"):
        assert abs(rows.taken.sum() - want[source]) <= rows["size"].max()


def test_reruns_agree_whatever_the_partitions(documents):
    a = mixing.mix(documents).toPandas().sort_values("doc_id", ignore_index=True)
    b = mixing.mix(documents.repartition(7, "n_chars")).toPandas().sort_values("doc_id", ignore_index=True)
    pd.testing.assert_frame_equal(a, b)


def test_expectation_is_kept():
    """Over many seeds, each row is taken as often as its chance says, and the sum of sizes is kept."""
    group = pd.DataFrame({"size": [5, 40, 7, 13, 1, 22], "p": [0.3, 0.5, 0.9, 0.1, 0.7, 0.25]})
    taken = np.zeros(6)
    for seed in range(4000):
        p = mixing._pivotal(group, (seed,))
        assert ((p > 0) & (p < 1)).sum() <= 1
        assert abs((p * group["size"]).sum() - (group["p"] * group["size"]).sum()) < 1e-9
        taken += p
    assert np.abs(taken / 4000 - group["p"]).max() < 0.03


def test_tree_of_residuals(make, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    rows = [(i, "w " * (i % 7 + 1), "en", "hot" if i % 3 else "cold") for i in range(300)]
    got = mixing.mix(make(rows)).toPandas()
    assert len(got) == 300
    for _, part in got.groupby("source"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 7


def test_odd_rows(make, odd_rows):
    rows = [(*r, "en", None if i % 2 else "a") for i, r in enumerate(odd_rows)]
    got = mixing.mix(make(rows, clashing=True)).toPandas()
    assert len(got) == len(rows)
    assert got[got.doc_id == 1]["size"].tolist() == [0]
    docs = make(rows, clashing=True)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    counts = defaultdict(int)
    for r in mixed.collect():
        counts[r["doc_id"]] += 1
    assert all(n <= 2 * sum(r[0] == d for r in rows) for d, n in counts.items())


def test_empty_table(make):
    assert mixing.mix(make([])).count() == 0

import math
import random
from collections import Counter

import numpy as np
import pytest

from wakeline.llm import toxicity as tx


@pytest.fixture(scope="module")
def corpus():
    """Documents of neutral words; toxic ones have one bad sentence among clean ones."""
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefghijklmn", k=rnd.randint(2, 7))) for _ in range(400)]
    texts, labels = [], []
    for i in range(600):
        body = [" ".join(rnd.choices(words, k=rnd.randint(3, 12))) for _ in range(rnd.randint(1, 25))]
        labels.append(int(i % 5 == 0))
        if labels[-1]:
            at = rnd.randrange(len(body))
            body[at] += " " + rnd.choice(["blorgface", "zwuckling", f"skrumm{rnd.choice(words)}"])
        texts.append(". ".join(body) + ".")
    return texts, labels


def test_learns_words_and_word_starts(corpus):
    texts, labels = corpus
    model = tx.train(texts[:400], labels[:400], np.ones(400))
    scorer = model.scorer()
    scores = [scorer.score(t)[0] for t in texts[400:]]
    assert [int(s >= 0.5) for s in scores] == labels[400:]


def test_offending_sentences_are_located(corpus):
    texts, labels = corpus
    model = tx.train(texts[:400], labels[:400], np.ones(400))
    for text, label in zip(texts[400:], labels[400:]):
        found = model.scorer().score(text)[1]
        assert bool(found) == bool(label)
        for start, length, p in found:
            assert p >= 0.5 and any(w in text[start : start + length] for w in ("blorgface", "zwuckling", "skrumm"))


def test_noisy_or_by_definition():
    model = tx.ToxicityModel({"=bad": 4.0, "^badl": 2.0, "=good": -1.0}, -3.0)
    p = lambda x: 1 / (1 + np.exp(-x))
    text = "A bad day. All is good!\nBadly done"
    want = 1 - (1 - p(1.0)) * (1 - p(-4.0)) * (1 - p(-1.0))
    assert model.scorer().score(text)[0] == pytest.approx(want)
    assert model.scorer().score("nothing. at all.")[0] == pytest.approx(1 - (1 - p(-3.0)) ** 2)
    assert model.scorer().score("") == (0.0, []) and model.scorer().score("... !!") == (0.0, [])


def test_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = tx.toxicity(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    unseen = got[got.held_out]
    assert (unseen.predicted == unseen.toxic).mean() > 0.96
    toxic, clean = unseen[unseen.toxic == 1].score, unseen[unseen.toxic == 0].score
    assert (toxic.to_numpy()[:, None] > clean.to_numpy()[None]).mean() > 0.95


def test_odd_rows(spark, make, odd_rows):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (5, 0), (5, 1), (None, 1), (99, 1), (8, None), (9, 7)], "doc_id long, toxic int")
    got = tx.toxicity(make(odd_rows, clashing=True), labels).collect()
    assert len(got) == len(odd_rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert {r["score"] for r in got if r["doc_id"] in (1, 2, 7)} == {0.0}


def test_empty_tables(spark, make):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.toxicity(make([]), none).count() == 0
    assert [r["predicted"] for r in tx.toxicity(make([(1, "a text")]), none).collect()] == [0]


def _plain(model, text):
    """The noisy-or over all sentences of a text, each from all features of all its words."""
    clean, found = 1.0, []
    for start, end, words in tx.sentences(text):
        x = model.bias + sum(model.weights.get(f, 0.0) for f in {f for w in words for f in tx.features(w)})
        p = 1.0 / (1.0 + math.exp(-min(30.0, max(-30.0, x))))
        clean *= 1.0 - p
        if p >= 0.5:
            found.append((start, end - start, p))
    return 1.0 - clean, found


@pytest.mark.parametrize("bias", [-6.0, 0.5])
def test_scores_are_those_of_all_sentences(documents, bias):
    """Whole texts of the table, with weights on words that many of them have, some of which cancel."""
    texts = [r["text"] or "" for r in documents.select("text").collect()]
    counts = Counter(w for t in texts for _, _, words in tx.sentences(t) for w in words)
    rng = random.Random(5)
    weights = {f: rng.choice([-2.0, -0.5, 0.5, 2.0, 7.0]) for w in rng.sample(sorted(counts), 400) for f in tx.features(w)[:2]}
    weights |= {"=the": 3.0, "^thei": -3.0, "=und": 1.5}
    model = tx.ToxicityModel(weights, bias)
    scorer, some = model.scorer(), 0
    for t in [*texts, "", "...", "The the. THE!\n\nund", "no end", "a" * 50_000]:
        score, found = scorer.score(t)
        expected, spans = _plain(model, t)
        assert score == pytest.approx(expected, abs=1e-12)
        assert [f[:2] for f in found] == [s[:2] for s in spans] and [f[2] for f in found] == pytest.approx([s[2] for s in spans], abs=1e-12)
        some += bool(found)
    assert some > 20

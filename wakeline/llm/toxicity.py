"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's chance z is logistic in its words and word starts; a document is
toxic unless every sentence is clean, 1 - prod(1 - z) (noisy-or). Training
follows the gradient of the documents' log loss through that product, so the
sentences that explain a label are found without a label of their own.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.batches import slices, texts_of
from wakeline.session import cut_lineage

SAMPLE = 6000  # labelled documents of a class that the fit reads, in expectation
STARTS = (4, 5, 6)  # lengths of word starts that are features beside the word
LEAST_DOCUMENTS = 3  # toxic documents of the sample that a feature must be in
LEAST_ODDS = 4.0  # times as common in toxic documents as in clean ones, smoothed
STEPS, RATE, SHRINK = 300, 0.1, 2e-5
REMEMBERED_WORDS = 300_000
TOKEN = re.compile(r"[^\W_]+|[.!?\n]+")
ENDS = frozenset(".!?\n")


def features(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:n]}" for n in STARTS if len(word) > n)]


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """Start, end and lower-case words of each sentence that has a word; ends are . ! ? and line ends."""
    out, words, start, end = [], [], 0, 0
    for m in TOKEN.finditer(text):
        if m[0][0] in ENDS:
            if words:
                out.append((start, m.end(), words))
            words = []
        else:
            start = start if words else m.start()
            words.append(m[0].lower())
            end = m.end()
    if words:
        out.append((start, end, words))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores texts inside one task; remembers the weight of each word."""

    def __init__(self, model: ToxicityModel):
        self._weights, self._bias, self._words = model.weights, model.bias, {}
        self._clean = math.log1p(-1.0 / (1.0 + math.exp(-model.bias)))  # log chance that a sentence without evidence is clean

    def _evidence(self, word: str) -> float:
        """How much the features of a token as written weigh, whatever their signs; NaN for a sentence end."""
        if word[0] in ENDS:
            return math.nan
        return sum(abs(self._weights.get(f, 0.0)) for f in set(features(word.lower())))

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and start, length and score of each sentence of a score of one half or more.

        Only sentences with a word that weighs anything are looked at; all
        others are equally likely to be clean.
        """
        tokens, known = TOKEN.findall(text), self._words
        if len(known) > REMEMBERED_WORDS:
            known.clear()
        for t in set(tokens).difference(known):
            known[t] = self._evidence(t)
        w = np.fromiter(map(known.__getitem__, tokens), np.float64, len(tokens))
        ends = np.isnan(w)
        # A sentence begins at each word that follows an end or nothing.
        number = np.cumsum(~ends & np.concatenate([[True], ends[:-1]])) if len(w) else w
        n = int(number[-1]) if len(w) else 0
        if not n:
            return 0.0, []
        telling: dict[int, set[str]] = {}
        for i in np.flatnonzero(w > 0.0).tolist():
            telling.setdefault(int(number[i]) - 1, set()).update(features(tokens[i].lower()))
        log_clean, found = (n - len(telling)) * self._clean, {}
        for k, own in telling.items():
            x = self._bias + sum(self._weights.get(f, 0.0) for f in own)
            p = 1.0 / (1.0 + math.exp(-min(30.0, max(-30.0, x))))
            log_clean += math.log1p(-p)
            if p >= 0.5:
                found[k] = p
        if self._bias >= 0.0:  # a sentence without evidence is offending too
            found = {k: found.get(k, 1.0 - math.exp(self._clean)) for k in range(n) if k in found or k not in telling}
        spans = sentences(text) if found else []
        return -math.expm1(log_clean), [(spans[k][0], spans[k][1] - spans[k][0], found[k]) for k in sorted(found)]


def train(texts: list[str], toxic: list[int], weights: np.ndarray) -> ToxicityModel:
    """Fit on documents with labels and sampling weights.

    Features are screened by how much commoner they are in toxic documents;
    Adam follows the noisy-or loss and a proximal step shrinks weights to 0.
    """
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        return ToxicityModel({}, -12.0 if not y.any() else 0.0)
    cut = [[s[2] for s in sentences(t)] for t in texts]
    seen = {True: Counter(), False: Counter()}
    for doc, label in zip(cut, toxic):
        seen[bool(label)].update({f for w in {w for s in doc for w in s} for f in features(w)})
    n1, n0 = int(y.sum()), int((~y).sum())
    bar = LEAST_ODDS
    names = sorted(f for f, c in seen[True].items() if c >= LEAST_DOCUMENTS and (c + 0.5) / (n1 + 1) > bar * (seen[False][f] + 0.5) / (n0 + 1))
    number = {f: i for i, f in enumerate(names)}
    doc_of, sent, feat, s = [], [], [], 0
    for d, doc in enumerate(cut):
        for words in doc:
            own = {number[f] for w in set(words) for f in features(w) if f in number}
            sent += [s] * len(own)
            feat += own
            doc_of.append(d)
            s += 1
    doc_of, sent, feat = np.array(doc_of, np.int64), np.array(sent, np.int64), np.array(feat, np.int64)
    importance = weights / weights.mean()
    theta, m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    theta[-1] = -5.0
    for step in range(1, STEPS + 1):
        p = np.clip(_sigmoid(np.bincount(sent, theta[feat], s) + theta[-1]), 1e-9, 1 - 1e-9)
        log_clean = np.bincount(doc_of, np.log1p(-p), len(texts))
        toxic_chance = np.maximum(-np.expm1(log_clean), 1e-9)
        pull = np.where(y, -np.exp(log_clean) / toxic_chance, 1.0) * importance
        dz = p * pull[doc_of]
        grad = np.append(np.bincount(feat, dz[sent], len(names)), dz.sum()) / len(texts)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        theta[:-1] = np.sign(theta[:-1]) * np.maximum(np.abs(theta[:-1]) - SHRINK * RATE * 10, 0.0)
    return ToxicityModel({f: float(t) for f, t in zip(names, theta) if t}, float(theta[-1]))


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> ToxicityModel:
    """Learn from texts whose doc_id has a label: about `sample` labels of each class, chosen by a hash of doc_id.

    That bounds the list of ids sent to the tasks, and with it the texts that
    are learned from; no text is shuffled but those.
    """
    rows = labels.filter("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not sizes:
        return ToxicityModel({}, -12.0)
    shares = {label: min(1.0, sample / n) for label, n in sizes.items()}
    share = F.element_at(F.create_map(*(F.lit(x) for label, r in shares.items() for x in (label, r))), F.col("toxic"))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 20)) < share * (1 << 20)
    texts = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = cut_lineage(texts.join(F.broadcast(rows.filter(drawn)), "doc_id"))

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "toxic", "text"], kind="stable")
        model = train(group["text"].tolist(), group["toxic"].tolist(), np.array([1 / shares[x] for x in group["toxic"]]))
        return pd.DataFrame([("", model.bias), *model.weights.items()], columns=["feature", "weight"])

    # The bounded sample is one group.
    fitted = {r["feature"]: r["weight"] for r in chosen.groupBy(F.lit(0).alias("all")).applyInPandas(learn, "feature string, weight double").collect()}
    return ToxicityModel(fitted, fitted.pop("", -12.0))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are not learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, predicted, offending (start, length and score of sentences of one half or more). Null texts are empty and score 0."""
    offending = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in slices(batches, "text"):
            got = [scorer.score(t) for t in texts_of(batch)]
            scores = np.array([g[0] for g in got], np.float64)
            spans = [[{"start": a, "length": n, "score": p} for a, n, p in g[1]] for g in got]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spans, offending)], ["doc_id", "score", "predicted", "offending"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, offending array<struct<start:int,length:int,score:double>>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, offending of every document; labels of held-out documents are not learned from."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "offending")

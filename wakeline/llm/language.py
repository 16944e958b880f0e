"""Language identification by the nearest of several centroids a language, on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.batches import mix, slices, texts_of
from wakeline.session import cut_lineage

UNKNOWN = "und"
DIMENSIONS = 1 << 13  # n-grams of two and three letters are hashed to so many
CENTROIDS = 3  # clusters of a language
SAMPLE = 1000  # labelled documents of a language that the fit reads, in expectation
MARGIN = 0.5  # of the least usual similarity in training; below it, a text is too far from every centroid
LONG = 200  # different n-grams from which on that holds in full; the usual similarity of fewer goes by their square root
GROUP = 64  # documents whose dense vectors a task holds at once
_SPACE = 32
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def _codes(text: str) -> np.ndarray:
    """Lower-case letters as code points; each run of anything else is one space, as are both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes[~_letter_table()[codes]] = _SPACE
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)
    return codes[keep]


def counts(texts: list[str]) -> np.ndarray:
    """How often each hashed n-gram of letters occurs in each text; a row of zeros where there is no letter."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i, text in enumerate(texts):
        c = _codes(text).astype(np.uint64)
        if len(c) < 2:
            continue
        two = c[:-1] | (c[1:] << np.uint64(21))
        grams = np.concatenate([two, two[:-1] | (c[2:] << np.uint64(42))])
        out[i] = np.bincount((mix(grams) >> np.uint64(64 - 13)).astype(np.int64), minlength=DIMENSIONS)
    return out


def _normalised(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def vectors(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit TF-IDF vectors with logarithmic term frequencies, and how usual a similarity to expect of them (0 to 1)."""
    found = counts(texts)
    return _normalised(np.log1p(found) * idf), np.sqrt(np.minimum(1.0, (found > 0).sum(axis=1) / LONG))


@dataclass
class LanguageModel:
    """Unit centroids, the language of each, and the similarity below which a language rejects a text."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    cutoffs: list[float]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine with its nearest centroid (0 to 1), and whether that is too far."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        score, nearest, usual = np.zeros(len(texts)), np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for a in range(0, len(texts), GROUP):
            b = min(a + GROUP, len(texts))
            rows, usual[a:b] = vectors(texts[a:b], self.idf)
            near = rows @ self.centroids.T
            score[a:b], nearest[a:b] = near.max(axis=1), near.argmax(axis=1)
        known = np.array([any(map(str.isalpha, t)) for t in texts], bool)
        score = np.where(known, np.clip(score, 0.0, 1.0), 0.0)
        langs = [self.languages[k] if ok else UNKNOWN for k, ok in zip(nearest, known)]
        return langs, score, ~known | (score < np.array(self.cutoffs)[nearest] * usual)


def _clusters(rows: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, each further one the row farthest from those before."""
    centres = _normalised(rows.mean(axis=0, keepdims=True))
    while len(centres) < min(k, len(rows)):
        far = (rows @ centres.T).max(axis=1).argmin()
        centres = np.concatenate([centres, rows[far : far + 1]])
    for _ in range(12):
        own = (rows @ centres.T).argmax(axis=1)
        sums = np.stack([rows[own == j].sum(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres = _normalised(sums)
    return centres


def fit(labelled: DataFrame, *, sample: int = SAMPLE, k: int = CENTROIDS) -> LanguageModel:
    """Learn from (doc_id, text, lang) rows with a language and a letter.

    The fit reads about `sample` documents of each language, chosen by a hash of
    doc_id; nothing but that sample, n-gram sums and centroids is gathered.
    Languages are taken to be few (codes, not texts).
    """
    rows = labelled.select("doc_id", "text", "lang").filter("lang is not null and doc_id is not null").filter(F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageModel(np.zeros(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), [], [])
    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n)))), F.col("lang"))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < share * (1 << 20)
    chosen = cut_lineage(rows.filter(drawn).select("doc_id", "lang", "text"))

    def present(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in slices(batches, "text"):
            texts = texts_of(batch)
            for a in range(0, len(texts), GROUP):
                seen += (counts(texts[a : a + GROUP]) > 0).sum(axis=0)
            n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS)), pa.array(np.concatenate([[n], seen]))], ["gram", "n"])

    found = {r["gram"]: r["n"] for r in chosen.select("text").mapInArrow(present, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    seen = np.array([found.get(g, 0) for g in range(DIMENSIONS)])
    idf = np.log((1 + found.get(-1, 0)) / (1 + seen)).astype(np.float32) + np.float32(1)

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id", kind="stable")
        texts = group["text"].tolist()
        rows = np.concatenate([vectors(texts[a : a + GROUP], idf)[0] for a in range(0, len(texts), GROUP)])
        centres = _clusters(rows, k)
        usual = np.quantile((rows @ centres.T).max(axis=1), 0.01)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": [c.tolist() for c in centres.astype(np.float32)], "cutoff": float(MARGIN * usual)})

    fitted = chosen.groupBy("lang").applyInPandas(cluster, "lang string, centroid array<float>, cutoff double").collect()
    fitted = sorted(((r["lang"], tuple(r["centroid"]), r["cutoff"]) for r in fitted))
    return LanguageModel(idf, np.array([f[1] for f in fitted], np.float32), [f[0] for f in fitted], [f[2] for f in fitted])


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row of `docs`; only `text` is looked at.

    A null text, or one without a letter, is UNKNOWN with score 0 and rejected.
    """

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            langs, score, rejected = model.predict(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of `docs` that some language accepts, with all their columns."""

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(~model.predict(texts_of(batch))[2]))

    return docs.mapInArrow(keep, docs.schema)


def fit_on(docs: DataFrame) -> LanguageModel:
    """A model of the rows that are not held out."""
    return fit(docs.filter(~held_out(F.col("doc_id"))))


def predicted_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    out = identify(docs, fit_on(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")

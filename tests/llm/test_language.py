import zlib

import numpy as np
from pyspark.sql import functions as F

from wakeline.llm import language


def test_held_out_accuracy(documents):
    got = language.predicted_languages(documents).toPandas().merge(documents.select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(got) == documents.count()
    assert got.held_out.tolist() == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got.doc_id]
    unseen = got[got.held_out & got.lang.notna()]
    assert (unseen.lang == unseen.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()
    assert got.rejected.mean() < 0.01  # the documents are all in learned languages


def test_nothing_but_the_text_is_looked_at(documents):
    model = language.fit_on(documents)
    a = language.identify(documents, model).toPandas().set_index("doc_id").sort_index()
    b = language.identify(documents.withColumns({"lang": F.lit("xx"), "source": F.lit("yy")}), model).toPandas().set_index("doc_id").sort_index()
    assert a.equals(b)


def test_far_texts_are_rejected_and_short_ones_are_not(make, documents):
    model = language.fit_on(documents)
    rows = [(1, "ъыщ жцчш эюя ъыщж " * 40), (2, "the"), (3, "数据 处理 语言 模型 " * 30), (4, "and of the thing in the house of the"), (5, "123 !!"), (6, None), (7, "")]
    kept = {r["doc_id"] for r in language.accepted(make(rows, clashing=True), model).collect()}
    assert kept == {2, 4}
    langs = {r["doc_id"]: r["lang_pred"] for r in language.identify(make(rows), model).collect()}
    assert {d for d, x in langs.items() if x == "und"} == {5, 6, 7}


def test_nearest_centroid_by_brute_force(documents):
    """Counts, weights and cosines computed text by text with plain dictionaries of n-grams."""
    model = language.fit_on(documents)
    texts = [r["text"] for r in documents.select("text").limit(20).collect()]
    langs, score, _ = model.predict(texts)
    for text, lang, found in zip(texts, langs, score):
        chars = [c if c.isalpha() else " " for c in f" {text.lower()} "]
        codes = [ord(c) for i, c in enumerate(chars) if c != " " or i == 0 or chars[i - 1] != " "]
        row = np.zeros(language.DIMENSIONS)
        for n in (2, 3):
            for i in range(len(codes) - n + 1):
                gram = sum(c << (21 * k) for k, c in enumerate(codes[i : i + n])) % (1 << 64)
                row[int(language.mix(np.array([gram], np.uint64))[0] >> np.uint64(51))] += 1
        row = np.log1p(row) * model.idf
        near = model.centroids @ (row / np.linalg.norm(row))
        assert model.languages[int(near.argmax())] == lang
        assert abs(near.max() - found) < 1e-4


def test_odd_rows(make, odd_rows):
    got = language.predicted_languages(make(odd_rows, clashing=True))
    assert got.count() == len(odd_rows)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "rejected"]


def test_empty_or_unlabelled(make):
    assert language.predicted_languages(make([])).count() == 0
    got = language.predicted_languages(make([(i, "some text", None, "s") for i in range(5)])).collect()
    assert {r["lang_pred"] for r in got} == {"und"}

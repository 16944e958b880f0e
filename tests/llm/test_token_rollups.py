import re
from collections import Counter

from wakeline.llm import token_rollups as tr
from wakeline.llm.files import new_folder
from wakeline.llm.tokens import tokenizer_path


def brute(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    first = {}
    for d, text, *_ in rows:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    keep = set(first.values())
    docs, tokens = Counter(), Counter()
    for d, text, lang, source in rows:
        if d is None or d in keep:
            text = text or ""
            for name, n in ((tr.BPE, len(t.encode(text, add_special_tokens=False).ids)), (tr.WORDS_2, len(re.findall(r"[^\W_]+", text)))):
                docs[source, lang, name] += 1
                tokens[source, lang, name] += n
    return {k: (docs[k], tokens[k]) for k in docs}


def result(df):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["documents"], r["tokens"]) for r in df.collect()}


def test_life_of_the_corpus(documents):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in documents.collect()]
    assert result(tr.rolled_up(documents)) == brute(rows)


def test_odd_rows(make, odd_rows):
    rows = [(*r, None if i % 3 == 0 else "en", "a" if i % 2 else None) for i, r in enumerate(odd_rows)]
    assert result(tr.rolled_up(make(rows, clashing=True))) == brute(rows)


def test_empty_table(make):
    assert tr.rolled_up(make([])).count() == 0


def test_batches_count_once_and_survive_compaction(spark):
    rollup = tr.Rollup(spark, new_folder(spark, "rollup"))
    counts = spark.createDataFrame([("s", "en", "t", 5), ("s", "en", "t", 7), ("s", "de", "t", 1)], "source string, lang string, tokenizer string, tokens long")
    assert rollup.totals().count() == 0
    assert rollup.apply("a", tr.inserted(counts))
    assert not rollup.apply("a", tr.inserted(counts))
    rollup.compact()
    assert not rollup.apply("a", tr.inserted(counts))
    assert rollup.apply("b", tr.deleted(counts.filter("lang = 'de'")))
    assert rollup.apply("c", tr.revised(counts.filter("tokens = 7"), counts.filter("tokens = 7").selectExpr("source", "lang", "tokenizer", "tokens + 3 as tokens")))
    assert result(rollup.totals()) == {("s", "en", "t"): (2, 15)}
    rollup.compact()
    rollup.compact()
    assert result(rollup.totals()) == {("s", "en", "t"): (2, 15)}
    assert rollup.committed() == {"a", "b", "c"}


def test_a_batch_cut_short_is_written_again(spark):
    folder = new_folder(spark, "rollup")
    rollup = tr.Rollup(spark, folder)
    counts = spark.createDataFrame([("s", "en", "t", 5)], "source string, lang string, tokenizer string, tokens long")
    tr.inserted(counts).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{folder}/batch/a")
    assert rollup.totals().count() == 0
    assert rollup.apply("a", tr.inserted(counts))
    assert result(rollup.totals()) == {("s", "en", "t"): (1, 5)}

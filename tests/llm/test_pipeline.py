from collections import Counter

import corpus_pipeline
from wakeline.llm import decontamination, language, near_duplicates
from wakeline.session import cut_lineage


def test_stages_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "token_files"]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(cut_lineage(stage(spark, seen[-1], sf)))
        assert len(seen) == 6 or seen[-1].columns == docs.columns
    ids = [Counter(r["doc_id"] for r in d.select("doc_id").collect()) for d in seen]
    # Language: exactly the documents that are not rejected.
    rejected = language.predicted_languages(docs).filter("rejected").select("doc_id").collect()
    assert ids[1] == ids[0] - Counter(r["doc_id"] for r in rejected)
    # One document of each group.
    assert ids[2] == Counter({r["group_id"] for r in near_duplicates.groups(seen[1]).collect()})
    # No passage of the benchmark is left, and nothing else is gone.
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = {r["doc_id"] for r in decontamination.report(seen[2], benchmark).collect()}
    assert found and ids[3] == ids[2] - Counter({d: 1 for d in found})
    assert decontamination.report(seen[3], benchmark).count() == 0
    # Words by source come near their targets: no document is in more than twice.
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].values()) <= 2
    # Every copy has its tokens, one after the other.
    rows = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in seen[5].collect())
    assert ids[5] == ids[4]
    assert all(a[0] + a[1] == b[0] and a[2] <= b[2] for a, b in zip(rows, rows[1:]))


def test_odd_documents(spark, make, odd_rows, sf):
    docs = make([*odd_rows, *((100 + i, "the house of the man and the dog in the garden " * 3) for i in range(3))], clashing=True)
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, sf))
    assert docs.filter("doc_id >= 100").count() <= 2


def test_no_documents(spark, make, sf):
    docs = make([])
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, sf))
    assert docs.count() == 0

import base64
import gzip
import hashlib

import pyarrow.fs as fs
from pyspark.sql import functions as F

from wakeline.llm import warc
from wakeline.llm.files import new_folder, opened

PAGES = "page_id long, url string, html string"
ODD = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2\r\nX: y", "<p>two</p>"), (3, None, "<p>one</p>"), (3, None, "<p>one</p>"), (4, "http://a/é", None),
    (5, "", ""), (None, "http://n", "<p>one</p>"), (None, "http://m", "only here"), (7, "http://a/7", "long é\U0001f600 " * 100_000), (3, "http://other", "<p>two</p>"),
]


def brute(rows):
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(page_id, first.get(html or "", page_id))
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        f = first.get(html or "")
        revisit = f is not None and f != page_id
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


def got(pages):
    return sorted(map(tuple, warc.archived(pages).collect()), key=str)


def test_odd_rows(spark):
    pages = spark.createDataFrame(ODD, PAGES).withColumns({c: F.lit(1) for c in ("first", "sha1", "offset", "file", "payload", "length")})
    assert got(pages) == brute(ODD)


def test_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert got(pages.select("page_id", "url", "html")) == brute([tuple(r) for r in pages.select("page_id", "url", "html").collect()])


def test_empty_table(spark):
    assert got(spark.createDataFrame([], PAGES)) == []


def test_small_payloads_are_no_revisits(spark):
    pages = spark.createDataFrame(ODD, PAGES)
    folder = new_folder(spark, "warc")
    kinds = {(r["page_id"], r["record_type"]) for r in warc.write_archives(pages, folder, least=10_000).collect()}
    assert {k for _, k in kinds} == {"response"}


def test_selected_records_and_their_payloads(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 40 + 1)) for i in range(500)], PAGES)
    folder = new_folder(spark, "warc")
    index = warc.write_archives(pages, folder)
    wanted = index.filter("url like '%3'")
    rows = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(wanted, folder).collect()}
    assert rows == {i: f"<p>{i}</p>" * (i % 40 + 1) for i in range(3, 500, 10)}


def test_archives_are_plain_gzip_members(spark):
    folder = new_folder(spark, "warc")
    index = warc.write_archives(spark.createDataFrame(ODD, PAGES), folder).collect()
    system, root = opened(folder)
    for info in system.get_file_info(fs.FileSelector(root)):
        whole = gzip.decompress(system.open_input_file(info.path).read())
        assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == sum(r["file"] == info.base_name for r in index)
        assert b"\r\nX: y" not in whole


def test_neighbouring_ranges_are_read_together(monkeypatch):
    monkeypatch.setattr(warc, "GAP_BYTES", 10)
    monkeypatch.setattr(warc, "RUN_BYTES", 100)
    assert warc.coalesced([]) == []
    assert warc.coalesced([(0, 5), (5, 5), (20, 10), (41, 5), (46, 90), (136, 6), (136, 5)]) == [(0, 3), (3, 5), (5, 7)]


def test_tasks_read_stretches_of_one_file(spark, monkeypatch):
    monkeypatch.setattr(warc, "STRETCH_BYTES", 2000)
    monkeypatch.setattr(warc, "TASK_BYTES", 4000)
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * 9) for i in range(300)], PAGES).coalesce(1)
    folder = new_folder(spark, "warc")
    rows = warc.read_archives(warc.write_archives(pages, folder), folder).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["page_id"] for r in rows) == list(range(300))
    assert len({r["task"] for r in rows}) > 5

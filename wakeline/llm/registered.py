"""The registered query of each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import conversation_trie, decontamination, html_text, language, mixing, near_duplicates, packing, periodic_runs, syncmers, token_files, token_rollups, toxicity, warc

QUERIES: dict = {}
STATEMENTS: dict[str, str] = {}


def query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_mixing")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op2_language")
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    return language.predicted_languages(table(spark, sf_dir, "documents"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, offending of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_warc")
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from the archives."""
    return warc.archived(table(spark, sf_dir, "pages"))


# Base32 by five bits at a time from the hexadecimal digest.
STATEMENTS["op4_warc"] = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as hex from pages
), d as (
  select *, min(page_id) over (partition by hex) as first,
    (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> (15 - 5 * (i % 4))) & 31)::int, 1), '' order by i)
     from (select i, list_sum([(strpos('0123456789abcdef', substr(hex, 1 + 5 * (i // 4) + k, 1)) - 1) * (16 ** (4 - k))::bigint for k in range(5)])::bigint as v
           from (select unnest(range(32)) as i))) as payload_digest
  from p
)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from d
"""


@query("op5_near_duplicates")
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, group_id, duplicate of every document."""
    return near_duplicates.groups(table(spark, sf_dir, "documents"))


@query("op8_decontamination")
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, matched of every document that holds a passage of a benchmark item."""
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Without seeds: all places where an item's and a document's token agree, counted by alignment.
STATEMENTS["op8_decontamination"] = r"""
with d as (
  select row_number() over () as r, doc_id, [x for x in string_split_regex(lower(text), '[^\p{L}\p{N}]+') if x <> ''] as w from documents
), b as (
  select min(item_id) as item_id, w, len(w) as n
  from (select item_id, [x for x in string_split_regex(lower(text), '[^\p{L}\p{N}]+') if x <> ''] as w from benchmark)
  where len(w) >= 2 group by w
), dt as (select r, doc_id, unnest(w) as t, generate_subscripts(w, 1) as i from d),
bt as (select item_id, n, unnest(w) as t, generate_subscripts(w, 1) as p from b),
m as (
  select doc_id, item_id, n, count(*) over (partition by r, item_id, i - p order by p range between 15 preceding and current row) as c
  from dt join bt using (t)
)
select doc_id, item_id, max(c) as matched from m where c >= case when n < 16 then n - n * 3 // 16 else 13 end group by doc_id, item_id
"""


@query("op9_html_text")
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op6_syncmers")
def op6_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, with their likeness."""
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


@query("op7_token_files")
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the files that hold all documents."""
    return token_files.token_files(table(spark, sf_dir, "documents"))


@query("op10_token_rollups")
def op10_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version after inserts, deletes and revisions of all documents."""
    return token_rollups.rolled_up(table(spark, sf_dir, "documents"))


@query("op11_packing")
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every document."""
    return packing.packed(table(spark, sf_dir, "documents")).drop("ids", "width").withColumn("length", F.col("length").cast("long"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the run of the most periods (start, length, period, exponent_milli), runs_sha256, collapsed_sha256 of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic_runs.looped().alias("text"))
    found = periodic_runs.periodic_runs(docs)
    # Runs are in order of start, then period: the first of the most periods stays.
    most = F.reduce("runs", F.get("runs", F.lit(0)), lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a))
    listed = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return found.withColumn("most", most).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "most.start", "most.length", "most.period",
        F.expr("1000 * most.length div most.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op13_conversation_trie")
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix tree of the rebuilt conversations."""
    convs = conversation_trie.conversations(table(spark, sf_dir, "conversations"))
    return conversation_trie.conversation_trie(conversation_trie.shared_starts(convs)).drop("key")

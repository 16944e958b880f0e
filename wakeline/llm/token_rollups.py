"""Token totals by source, language and tokenizer version, kept up by signed deltas.

Totals are sums, so a change of the corpus is a few added rows: an insert
counts +1 document and +n tokens, a delete takes both away, and a revised count
is a delete of the old and an insert of the new. A batch of changes is summed
to one row a key before anything moves, and is stored as a table of its own
under its id, complete once its writer's `_SUCCESS` marker stands. A batch
delivered twice, or retried after a crash, therefore counts once. `compact()`
folds batches into a base table that lists what it has absorbed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.batches import slices
from wakeline.llm.files import new_folder
from wakeline.llm.tokens import LOOKED_UP_BYTES, encoder, tokenizer_path
from wakeline.session import cut_lineage

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["documents", "tokens"]

# Tokenizer versions that count_tokens() knows, besides the public vocabulary.
BPE = "word_bpe_49k"
WORDS_1 = "words-1"  # runs of other than white space
WORDS_2 = "words-2"  # runs of letters and digits
PATTERNS = {WORDS_1: r"[^\x20\x09-\x0D]+", WORDS_2: r"[\p{L}\p{N}]+"}


def count_tokens(docs: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """One row a document and tokenizer version: doc_id, source, lang, text_hash, tokenizer, tokens.

    A null text is empty and has no tokens; null sources and languages are keys of their own.
    """
    path = tokenizer or tokenizer_path()
    schema = "doc_id long, source string, lang string, text_hash long, tokenizer string, tokens long"

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in slices(batches, "text", LOOKED_UP_BYTES):
            found = {BPE: pa.array(words.count(batch.column("text")), pa.int64())}
            found |= {name: pc.count_substring_regex(batch.column("text"), p).cast(pa.int64()) for name, p in PATTERNS.items()}
            for name, tokens in found.items():
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("doc_id", "source", "lang", "text_hash")), pa.array(np.full(batch.num_rows, name)).cast(pa.string()), tokens],
                    ["doc_id", "source", "lang", "text_hash", "tokenizer", "tokens"],
                )

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(count, schema)


def _signed(counts: DataFrame, sign: int) -> DataFrame:
    return counts.select(*KEYS, F.lit(sign).cast("long").alias("documents"), (F.col("tokens") * sign).cast("long").alias("tokens"))


def inserted(counts: DataFrame) -> DataFrame:
    return _signed(counts, 1)


def deleted(counts: DataFrame) -> DataFrame:
    return _signed(counts, -1)


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Old counts out, new counts in."""
    return deleted(before).unionByName(inserted(after))


def _sum(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))


class Rollup:
    """The totals below one shared folder. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self.folder = spark, folder

    def _complete(self, kind: str) -> list[str]:
        """Names of the finished tables of a kind."""
        jvm = self._spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        system = path.getFileSystem(self._spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        names = [s.getPath().getName() for s in system.listStatus(path)]
        return sorted(n for n in names if system.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}/{n}/_SUCCESS")))

    def _schema(self) -> str:
        return "source string, lang string, tokenizer string, documents long, tokens long"

    def _base(self) -> tuple[str | None, set[str]]:
        """The newest base and the batches that are in it."""
        if not (bases := self._complete("absorbed")):
            return None, set()
        rows = self._spark.read.schema("batch string").parquet(f"{self.folder}/absorbed/{bases[-1]}").collect()
        return bases[-1], {r["batch"] for r in rows}

    def committed(self) -> set[str]:
        return set(self._complete("batch")) | self._base()[1]

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed rows under its id; False if that batch already counts."""
        if batch in self.committed():
            return False
        _sum(changes).filter("documents <> 0 or tokens <> 0").write.mode("overwrite").parquet(f"{self.folder}/batch/{batch}")
        return True

    def compact(self) -> None:
        """Fold all batches into one base. The list of what it holds is written last and makes it count."""
        base, absorbed = self._base()
        absorbed |= set(self._complete("batch"))
        name = f"{int(base or 0) + 1:012d}"
        self.totals().write.mode("overwrite").parquet(f"{self.folder}/base/{name}")
        self._spark.createDataFrame([(b,) for b in sorted(absorbed)], "batch string").write.mode("overwrite").parquet(f"{self.folder}/absorbed/{name}")

    def totals(self) -> DataFrame:
        """Sums over all committed batches; keys that no document is left under have no row."""
        base, absorbed = self._base()
        paths = [f"{self.folder}/batch/{b}" for b in self._complete("batch") if b not in absorbed]
        paths += [f"{self.folder}/base/{base}"] if base else []
        if not paths:
            return self._spark.createDataFrame([], self._schema())
        return _sum(self._spark.read.schema(self._schema()).parquet(*paths)).filter("documents <> 0 or tokens <> 0")


def rolled_up(docs: DataFrame, *, folder: str | None = None) -> DataFrame:
    """A corpus's life in three batches, each delivered twice: source, lang, tokenizer, documents, tokens.

    All documents are inserted under two tokenizer versions; exact copies of a
    text are deleted but for the smallest doc_id; the documents left have their
    words-1 counts revised to words-2. Rows without a doc_id are never deleted,
    and rows that repeat a doc_id go or stay together.
    """
    spark = docs.sparkSession
    rollup = Rollup(spark, folder or new_folder(spark, "rollup"))
    counts = cut_lineage(count_tokens(docs))
    first = counts.filter("doc_id is not null").groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"))
    copies = counts.filter("doc_id is not null").join(first.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id").distinct()
    left = cut_lineage(counts.join(copies, "doc_id", "left_anti"))
    batches = {
        "1-insert": inserted(counts.filter(F.col("tokenizer") != WORDS_2)),
        "2-delete": deleted(counts.join(copies, "doc_id", "left_semi").filter(F.col("tokenizer") != WORDS_2)),
        "3-revise": revised(left.filter(F.col("tokenizer") == WORDS_1), left.filter(F.col("tokenizer") == WORDS_2)),
    }
    for _ in range(2):
        for name, changes in batches.items():
            rollup.apply(name, changes)
    rollup.compact()
    return rollup.totals()

"""Session helpers: sane defaults for tests and a fault-tolerant lineage cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", name: str = "wakeline") -> SparkSession:
    """A session for tests and local benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's `spark.checkpoint.dir`.

    Only a local session without that setting gets a scratch folder; elsewhere
    each executor would write to a disk of its own, and later reads would miss
    rows without an error.
    """
    global _scratch
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is unset; name a folder that all executors share")
    _scratch = _scratch or tempfile.mkdtemp(prefix="spark-")
    return _scratch


_scratch: str | None = None


def cut_lineage(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Materialise `df` once as a table in the shared folder (or `folder`) and read it back.

    A written table survives the loss of executors, and unlike a row checkpoint
    it keeps column pruning, filter pushdown and honest size statistics for
    everything downstream.
    """
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/wakeline/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

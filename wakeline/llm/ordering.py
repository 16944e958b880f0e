"""Deal a table into key ranges, for operators that need the global order of an integer key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE = "_range"


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def range_bounds(df: DataFrame, key: str, ranges: int) -> list[int]:
    """At most `ranges` - 1 ascending keys, each the first of a range; the ranges hold about as many rows each.

    The driver gets these keys alone, at most one for each shuffle partition.
    """
    if ranges < 2:
        return []
    shares = [k / ranges for k in range(1, ranges)]
    found = df.agg(F.percentile_approx(F.col(key).cast("long"), shares, max(1000, 10 * ranges)).alias("b")).first()["b"]
    return sorted(set(found or []))


def with_range(df: DataFrame, key: str, bounds: list[int]) -> DataFrame:
    """Adds the number of the key's range (`_range`); rows without a key are in the last."""
    edges = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        missing = keys.isna()
        at = np.searchsorted(edges, keys.fillna(0).to_numpy(dtype=np.int64), side="right")
        return pd.Series(np.where(missing, len(edges), at).astype(np.int32))

    return df.withColumn(RANGE, place(F.col(key).cast("long")))


def in_ranges(df: DataFrame, ranges: int, *order) -> DataFrame:
    """One partition for each range number, sorted inside by `order`."""
    return df.repartitionById(max(1, ranges), F.col(RANGE)).sortWithinPartitions(RANGE, *order)

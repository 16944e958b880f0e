"""Running values along a key of any length: a scan over time slices.

A window over one key sorts all of it in one task. Where a look-around has no
bound in time, no halo helps; but what a slice passes on to the next is small.
Each slice is windowed alone and summed up in a row (its first and last row, its
last value, its count), these rows are chained in order along the key, and
every row takes what its slice inherits. A key then costs one task a row for
each slice, and its rows spread over as many tasks as it has slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"


def sliced(df: DataFrame, at: str, size: float) -> DataFrame:
    return df.withColumn(SLICE, F.floor(F.col(at) / size))


def inherit(rows: DataFrame, chain: DataFrame, keys: list[str], nullable: list[str]) -> DataFrame:
    """Rows with the columns of their slice's chain row; `nullable` keys may be null."""
    ids = [*keys, SLICE]
    other = chain.select(*[F.col(k).alias(f"_k_{k}") for k in ids], *[c for c in chain.columns if c not in ids])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) if k in nullable else F.col(k) == F.col(f"_k_{k}") for k in ids]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return rows.join(other, on).drop(*[f"_k_{k}" for k in ids])


def neighbours(rows: DataFrame, keys: list[str], at: str, columns: list[str], nullable: list[str] = ()) -> DataFrame:
    """Add `prev` and `next`, the `columns` of the rows before and after in order of `at`; null at the ends of a key."""
    own, w = F.struct(*columns), Window.partitionBy(*keys, SLICE).orderBy(at)
    along = Window.partitionBy(*keys).orderBy(SLICE)
    ends = rows.groupBy(*keys, SLICE).agg(F.min_by(own, at).alias("first"), F.max_by(own, at).alias("last"))
    chain = ends.select(*keys, SLICE, F.lag("last").over(along).alias("_before"), F.lead("first").over(along).alias("_after"))
    beside = rows.select("*", F.lag(own).over(w).alias("prev"), F.lead(own).over(w).alias("next"))
    out = inherit(beside, chain, keys, list(nullable))
    return out.withColumns({"prev": F.coalesce("prev", "_before"), "next": F.coalesce("next", "_after")}).drop("_before", "_after")


def filled(rows: DataFrame, keys: list[str], at: str, name: str, value: Column, nullable: list[str] = ()) -> DataFrame:
    """Add `name`: the last `value` that is not null, up to the row."""
    rows = rows.withColumn(name, value)
    w = Window.partitionBy(*keys, SLICE).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, SLICE).agg(F.max_by(name, F.when(F.col(name).isNotNull(), F.col(at))).alias("_own"))
    chain = ends.select(*keys, SLICE, F.last("_own", ignorenulls=True).over(before).alias("_carried"))
    here = rows.withColumn(name, F.last(name, ignorenulls=True).over(w))
    return inherit(here, chain, keys, list(nullable)).withColumn(name, F.coalesce(name, "_carried")).drop("_carried")


def counted(rows: DataFrame, keys: list[str], at: str, name: str, flag: Column, nullable: list[str] = ()) -> DataFrame:
    """Add `name`: how many rows up to this one have the flag."""
    rows = rows.withColumn(name, F.coalesce(flag, F.lit(False)).cast("long"))
    w = Window.partitionBy(*keys, SLICE).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    chain = rows.groupBy(*keys, SLICE).agg(F.sum(name).alias("_own")).select(*keys, SLICE, F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_carried"))
    here = rows.withColumn(name, F.sum(name).over(w))
    return inherit(here, chain, keys, list(nullable)).withColumn(name, F.col(name) + F.col("_carried")).drop("_carried")

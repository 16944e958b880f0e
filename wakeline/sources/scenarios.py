"""Nested scenario documents: flight plans, quality checks, fingerprints."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D, _S = T.DoubleType(), T.StringType()
COMMAND = T.StructType(
    [T.StructField("kind", _S), T.StructField("at_s", _D)]
    + [T.StructField(n, _D) for n in ("heading_deg", "rate_deg_s", "altitude_ft", "rate_fpm", "ground_speed_kt", "acceleration_kt_s")]
    + [T.StructField("squawk", _S)]
)
AIRCRAFT = T.StructType(
    [T.StructField("icao24", _S), T.StructField("callsign", _S), T.StructField("squawk", _S), T.StructField("entry_time_s", _D),
     T.StructField("initial", T.StructType([T.StructField(n, _D) for n in (
         "lat", "lon", "altitude_ft", "ground_speed_kt", "track_deg", "vertical_rate_fpm")])),
     T.StructField("plan", T.ArrayType(COMMAND))]
)
SCENARIO = T.StructType(
    [T.StructField("scenario_id", _S), T.StructField("family", _S), T.StructField("description", _S),
     T.StructField("seed", T.LongType()), T.StructField("duration_s", _D), T.StructField("aircraft", T.ArrayType(AIRCRAFT))]
)


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Scenario documents, one JSON object per line."""
    return spark.read.schema(SCENARIO).json(path)


def aircraft(scenarios: DataFrame) -> DataFrame:
    return scenarios.select("scenario_id", "duration_s", F.explode("aircraft").alias("a")).select("scenario_id", "duration_s", "a.*")


def flight_plans(scenarios: DataFrame) -> DataFrame:
    """One row per scripted command."""
    return aircraft(scenarios).select("scenario_id", "icao24", F.explode("plan").alias("c")).select("scenario_id", "icao24", "c.at_s", "c.kind")


def violations(specs: DataFrame) -> DataFrame:
    """Aircraft rows (scenario_id, icao24, callsign, entry_time_s, duration_s) that break a scenario."""

    def repeated(field: str) -> DataFrame:
        return (
            specs.groupBy("scenario_id", F.col(field).alias("value")).count().where("count > 1")
            .select("scenario_id", F.lit(f"duplicate_{field}").alias("violation"), "value")
        )

    late = specs.where("entry_time_s >= duration_s").select("scenario_id", F.lit("enters_after_end").alias("violation"), F.col("callsign").alias("value"))
    return repeated("icao24").unionByName(repeated("callsign")).unionByName(late)


def _canonical(name: str, dtype: T.DataType) -> Column:
    c = F.col(name)
    if isinstance(dtype, T.DoubleType):
        # Adding zero folds -0.0 into 0.0.
        return (F.round(c, 9) + 0.0).cast("string").alias(name)
    return c.cast("string").alias(name)


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row's canonical text, blind to the last digits of floats."""
    fields = [F.coalesce(_canonical(f.name, f.dataType), F.lit("null")) for f in df.schema.fields]
    return F.sha2(F.concat_ws("|", *fields), 256)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: an order-insensitive digest of the whole table.

    Row digests are added up in eight 32-bit lanes, so any partition folds to
    eight numbers and no row list is ever collected; the digest of the sums
    and the row count identify the multiset.
    """
    h = df.select(row_digest(df).alias("h"))
    lanes = [
        F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"lane{i}") for i in range(8)
    ]
    folded = h.agg(F.count("*").alias("rows"), *lanes)
    text = functools.reduce(
        lambda a, b: F.concat_ws(":", a, b), [F.coalesce(F.col(f"lane{i}"), F.lit(0)).cast("string") for i in range(8)]
    )
    return folded.select("rows", F.substring(F.sha2(F.concat_ws(":", F.col("rows").cast("string"), text), 256), 1, 16).alias("fingerprint"))

"""Twenty-update window features for trajectory residual models."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.operators.picture import SCAN_INTERVAL_S, STALE_AFTER_S
from wakeline.operators.slices import SLICE_S, drop_halo, with_halo

# Fixed values that results depend on.
WINDOW = 20
LEVEL_FPM = 300.0
STRAIGHT_DEG_S = 0.15
HIGH_ALTITUDE_FT = 29000.0
FEATURES = [
    "ground_speed_kt", "vertical_rate_fpm", "turn_rate_deg_s", "altitude_kft", "position_uncertainty_m",
    "innovation_nm", "speed_change_kt", "heading_change_deg", "altitude_change_ft", "turn_rate_mean",
    "turn_rate_std", "turn_rate_abs_max", "vertical_rate_mean", "vertical_rate_std", "innovation_mean",
    "innovation_max", "is_climbing", "is_descending", "is_turning", "is_high_altitude",
]
FEATURE_COLUMNS = [f"f_{name}" for name in FEATURES]

_TRACK = ["scenario_id", "track_id"]


def breaks(updates_window):
    """1 where the track went stale (a scan found it gone) before this update."""
    tick, stale = int(SCAN_INTERVAL_S * 1e6), int(STALE_AFTER_S * 1e6)
    prev = F.lag("t_us").over(updates_window)
    gone = (F.floor((prev + stale) / tick) + 1) * tick
    return F.coalesce((gone < F.col("t_us")).cast("int"), F.lit(0))


def with_features(updates: DataFrame, *, slice_s: float = SLICE_S) -> DataFrame:
    """Updates plus twenty feature columns; null until a full unbroken window exists.

    A window never spans a spell in which the track had vanished. Within a
    spell updates are at most a staleness interval apart, so the look-back is
    bounded in time and the windows run per (track, time slice).
    """
    reach = WINDOW * (STALE_AFTER_S + SCAN_INTERVAL_S)
    seen = with_halo(updates, before_s=reach, slice_s=slice_s)
    order = Window.partitionBy(*_TRACK, "slice").orderBy("t_us")
    w = order.rowsBetween(-(WINDOW - 1), 0)
    inner = order.rowsBetween(-(WINDOW - 2), 0)
    inn = F.coalesce("innovation_nm", F.lit(0.0))
    rows = seen.withColumn("broken", breaks(order))
    vr, tr, alt = F.col("vertical_rate_fpm"), F.col("turn_rate_deg_s"), F.col("altitude_ft")
    values = [
        F.col("ground_speed_kt"), vr, tr, alt / 1000.0, F.col("position_uncertainty_m"), inn,
        F.col("ground_speed_kt") - F.first("ground_speed_kt").over(w),
        geo.bearing_difference(F.first("track_deg").over(w), "track_deg"),
        alt - F.first("altitude_ft").over(w),
        F.avg(tr).over(w), F.stddev_pop(tr).over(w), F.max(F.abs(tr)).over(w),
        F.avg(vr).over(w), F.stddev_pop(vr).over(w),
        F.avg(inn).over(w), F.max(inn).over(w),
        (vr > LEVEL_FPM).cast("double"), (vr < -LEVEL_FPM).cast("double"),
        (F.abs(tr) > STRAIGHT_DEG_S).cast("double"), (alt > HIGH_ALTITUDE_FT).cast("double"),
    ]
    whole = (F.count("*").over(w) == WINDOW) & (F.sum("broken").over(inner) == 0)
    full = rows.withColumn("whole", whole)
    out = full.select("*", *[F.when(F.col("whole"), v).alias(c) for c, v in zip(FEATURE_COLUMNS, values)])
    return drop_halo(out).drop("broken", "whole")


def complete(features: DataFrame) -> DataFrame:
    """Only rows with a full window."""
    return features.where(F.col(FEATURE_COLUMNS[0]).isNotNull())


def _by_feature(features: DataFrame, **sums: Callable[[Column], Column]) -> DataFrame:
    """Aggregates of every feature from one pass: feature, then a column for each of `sums`."""
    each = [F.struct(F.lit(n).alias("feature"), *[f(F.col(c)).alias(name) for name, f in sums.items()]) for n, c in zip(FEATURES, FEATURE_COLUMNS)]
    return features.agg(F.array(*each).alias("all")).select(F.inline("all"))


def non_finite_counts(features: DataFrame) -> DataFrame:
    """Per feature, how many values are NaN or infinite."""
    inf = float("inf")
    return _by_feature(features, rows=lambda c: F.count("*"), non_finite=lambda c: F.count_if(F.isnan(c) | c.isin(inf, -inf)))


def require_finite(features: DataFrame) -> None:
    """Raise, naming a column and a row, if any feature is not finite."""
    inf = float("inf")
    bad = [F.isnan(c) | F.col(c).isin(inf, -inf) for c in FEATURE_COLUMNS]
    first = features.where(functools.reduce(lambda a, b: a | b, bad)).select(*_TRACK, "t_us", *FEATURE_COLUMNS).take(1)
    if first:
        row = first[0]
        name = next(n for n, c in zip(FEATURES, FEATURE_COLUMNS) if row[c] != row[c] or abs(row[c]) == inf)
        raise ValueError(f"non-finite value in feature {name!r} at {row['scenario_id']}/{row['track_id']}/{row['t_us']}")


def describe(features: DataFrame) -> DataFrame:
    """Mean, population deviation, minimum and maximum of every feature."""
    return _by_feature(features, mean=F.avg, std=F.stddev_pop, min=F.min, max=F.max)


def standardiser(features: DataFrame) -> DataFrame:
    """Per feature mean and scale; a constant feature keeps scale one."""
    d = describe(features)
    return d.select("feature", "mean", F.when(F.col("std") < 1e-9, 1.0).otherwise(F.col("std")).alias("scale"))

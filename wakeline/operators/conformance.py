"""Predict every track ahead and check each prediction when its moment comes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.operators.features import breaks
from wakeline.operators.slices import SLICE_S, drop_halo, with_halo

# Fixed values that results depend on.
HORIZON_S = 60.0
THRESHOLD_FACTOR = 3.0
THRESHOLD_FLOOR_NM = 1.5
MATCH_TOLERANCE_S = 3.0
TYPICAL_ERROR_NM = {
    "model": {30.0: 0.412, 60.0: 1.220, 120.0: 2.732},
    "dead_reckoning": {30.0: 1.007, 60.0: 2.412, 120.0: 5.085},
}

_TRACK = ["scenario_id", "track_id"]


def predictions(updates: DataFrame, horizon_s: float = HORIZON_S) -> DataFrame:
    """Where each update would be at the horizon.

    Where `r_along`, `r_cross` and `r_alt` residual columns exist and are
    finite, they correct dead reckoning and the source is the model; anything
    else falls back to physics. `source` says which.
    """
    h = F.lit(horizon_s)
    out = geo.with_projected(updates, "base", "lat", "lon", "track_deg", "ground_speed_kt", h).withColumn("base_alt", geo.dead_reckoned_altitude("altitude_ft", "vertical_rate_fpm", h))
    if "r_along" not in updates.columns:
        out, alt, source = out.withColumn("place", F.col("base")), F.col("base_alt"), F.lit("dead_reckoning")
    else:
        inf = float("inf")
        usable = None
        for c in ("r_along", "r_cross", "r_alt"):
            ok = F.col(c).isNotNull() & ~F.isnan(c) & ~F.col(c).isin(inf, -inf)
            usable = ok if usable is None else usable & ok
        out = geo.with_applied(out, "moved", "base.lat", "base.lon", "r_along", "r_cross", "track_deg")
        out = out.withColumn("place", F.when(usable, F.col("moved")).otherwise(F.col("base")))
        alt = F.when(usable, F.greatest(F.lit(0.0), F.col("base_alt") + F.col("r_alt"))).otherwise(F.col("base_alt"))
        source = F.when(usable, "model").otherwise("dead_reckoning")
    return out.select(
        *updates.columns,
        F.col("place.lat").alias("p_lat"), F.col("place.lon").alias("p_lon"), alt.alias("p_altitude_ft"),
        F.col("base.lat").alias("b_lat"), F.col("base.lon").alias("b_lon"),
        source.alias("source"), h.alias("horizon_s"),
    )


def threshold(source, horizon_s: float, typical: dict | None = None) -> Column:
    """Allowed deviation: a multiple of the typical error, never below the floor."""
    table = typical if typical is not None else TYPICAL_ERROR_NM
    s = F.col(source)
    out = F.lit(None).cast("double")
    for name, by_horizon in table.items():
        if horizon_s in by_horizon:
            out = F.when(s == name, F.lit(by_horizon[horizon_s])).otherwise(out)
    return F.coalesce(F.greatest(F.lit(THRESHOLD_FLOOR_NM), out * THRESHOLD_FACTOR), F.lit(THRESHOLD_FLOOR_NM))


def calibrated_thresholds(rows: DataFrame, calibration: DataFrame) -> DataFrame:
    """`threshold_nm` for (source, horizon_s) rows from a calibration table; uncalibrated means the floor."""
    return rows.join(calibration, ["source", "horizon_s"], "left").withColumn(
        "threshold_nm",
        F.coalesce(F.greatest(F.lit(THRESHOLD_FLOOR_NM), F.col("typical_nm") * THRESHOLD_FACTOR), F.lit(THRESHOLD_FLOOR_NM)),
    )


def matured(predicted: DataFrame, *, horizon_s: float = HORIZON_S, tolerance_s: float = MATCH_TOLERANCE_S,
            slice_s: float = SLICE_S) -> DataFrame:
    """Each prediction beside the first update at or after horizon - tolerance.

    The match must also be no later than horizon + tolerance, which makes it
    the first row of a range frame: no join. A prediction does not survive a
    spell in which its track had vanished.
    """
    lo, hi = int((horizon_s - tolerance_s) * 1e6), int((horizon_s + tolerance_s) * 1e6)
    seen = with_halo(predicted.where("state <> 'terminated'"), after_s=horizon_s + tolerance_s, slice_s=slice_s)
    order = Window.partitionBy(*_TRACK, "slice").orderBy("t_us")
    run = seen.withColumn("broken", breaks(order))
    run = run.withColumn("run_no", F.sum("broken").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ahead = order.rangeBetween(lo, hi)
    hit = F.first(F.struct("t_us", "lat", "lon", "callsign", "run_no")).over(ahead)
    found = drop_halo(run.withColumn("hit", hit)).where(F.col("hit.run_no") == F.col("run_no"))
    return judged(found)


def judged(found: DataFrame) -> DataFrame:
    """Errors of predictions that have met the update that resolves them (`hit`)."""
    met = found.select(
        *_TRACK, F.col("icao24"), F.col("t_us").alias("predicted_us"), F.col("hit.t_us").alias("matched_us"), F.col("hit.callsign").alias("callsign"),
        "source", "horizon_s", "p_lat", "p_lon", "b_lat", "b_lon", F.col("hit.lat").alias("hit_lat"), F.col("hit.lon").alias("hit_lon"),
    )
    met = geo.with_haversine(met, "error_nm", "p_lat", "p_lon", "hit_lat", "hit_lon")
    met = geo.with_haversine(met, "baseline_error_nm", "b_lat", "b_lon", "hit_lat", "hit_lon")
    return met.select(
        *_TRACK, "icao24", "predicted_us", "matched_us", "callsign", "source", "horizon_s",
        F.concat_ws("-", F.lit("wakeline"), "source", F.lit("v1")).alias("predictor_version"),
        "error_nm",
        "baseline_error_nm",
    )


def deviations(checked: DataFrame, *, horizon_s: float = HORIZON_S, typical: dict | None = None, calibration: DataFrame | None = None) -> DataFrame:
    """Worst deviation beyond its threshold per track and resolving update.

    Thresholds come from a fitted `calibration` (source, horizon_s, typical_nm)
    where there is one, else from fixed typical errors.
    """
    if calibration is None:
        judged = checked.withColumn("threshold_nm", threshold("source", horizon_s, typical))
    else:
        judged = calibrated_thresholds(checked, calibration.select("source", "horizon_s", "typical_nm")).select(*checked.columns, "threshold_nm")
    over = judged.where("error_nm > threshold_nm")
    ids = [*_TRACK, "matched_us"]
    rest = [c for c in over.columns if c not in ids]
    # Equal errors go to the older prediction.
    rank = F.struct("error_nm", (-F.col("predicted_us")).alias("older"))
    return over.groupBy(*ids).agg(F.max_by(F.struct(*rest), rank).alias("d")).select(*ids, "d.*")


def per_scan(found: DataFrame, picture: DataFrame, tick_s: float = 1.0) -> DataFrame:
    """The latest deviation of each track between two scans, at the later scan."""
    tick = int(tick_s * 1e6)
    at = found.withColumn("tick_us", F.ceil(F.col("matched_us") / tick) * tick)
    ids = [*_TRACK, "tick_us"]
    rest = [c for c in at.columns if c not in ids]
    latest = at.groupBy(*ids).agg(F.max_by(F.struct(*rest), "matched_us").alias("d")).select(*ids, "d.*")
    return latest.join(picture.select(*ids, "vanish_tick_us"), ids, "left")

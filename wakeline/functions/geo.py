"""Spherical geometry as native Column expressions.

Everything here is a composition of built-in functions, so it stays inside
whole-stage codegen and is shared by batch, streaming and SQL callers.
Angles are degrees, distances nautical miles, speeds knots, rates feet/minute.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from wakeline.functions.once import computed_once

# Fixed values that results depend on.
EARTH_RADIUS_NM = 3440.0695
POLE_COSINE = 1e-12
STEADY_TURN_DEG_S = 1e-6
FLAT_TURN_RAD_S = 1e-9
COINCIDENT_NM = 1e-9
TURN_LEGS = 12


def col(x) -> Column:
    """Accept a column name, a number or a Column."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def at_least(x, low: float) -> Column:
    """`greatest` that keeps nulls null."""
    c = col(x)
    return F.when(c < low, F.lit(low)).otherwise(c)


def clamp(x, low: float, high: float) -> Column:
    """Limit to [low, high], keeping nulls null."""
    c = col(x)
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def knots_to_nm_per_second(kt) -> Column:
    return col(kt) / 3600.0


def fpm_to_ft_per_second(fpm) -> Column:
    return col(fpm) / 60.0


def normalize_bearing(deg) -> Column:
    """Wrap into [0, 360); tiny negatives must not round up to 360 itself."""
    wrapped = F.pmod(col(deg), F.lit(360.0))
    return F.when(wrapped >= 360.0, F.lit(0.0)).otherwise(wrapped)


def bearing_difference(from_deg, to_deg) -> Column:
    """Signed shortest turn, in (-180, 180]."""
    d = F.pmod(col(to_deg) - col(from_deg) + 180.0, F.lit(360.0)) - 180.0
    return F.when(d <= -180.0, d + 360.0).otherwise(d)


def wrap_longitude(lon) -> Column:
    return F.pmod(col(lon) + 180.0, F.lit(360.0)) - 180.0


def _between(lat1, lon1, lat2, lon2) -> dict[str, Column]:
    """Sines and cosines that the distance and bearing between two points are made of."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dl = F.radians(col(lon2) - col(lon1))
    return {
        "half_lat": F.sin((p2 - p1) / 2.0), "half_lon": F.sin(dl / 2.0), "sin1": F.sin(p1), "cos1": F.cos(p1),
        "sin2": F.sin(p2), "cos2": F.cos(p2), "sin_dl": F.sin(dl), "cos_dl": F.cos(dl),
    }


def _half_chord(b: dict[str, Column]) -> Column:
    a = b["half_lat"] * b["half_lat"] + b["cos1"] * b["cos2"] * b["half_lon"] * b["half_lon"]
    return F.sqrt(a)


def _distance_nm(half_chord: Column) -> Column:
    return F.asin(clamp(half_chord, 0.0, 1.0)) * (2.0 * EARTH_RADIUS_NM)


def _heading(b: dict[str, Column]) -> tuple[Column, Column]:
    """North and east of a departure bearing."""
    return b["cos1"] * b["sin2"] - b["sin1"] * b["cos2"] * b["cos_dl"], b["sin_dl"] * b["cos2"]


def _bearing(x: Column, y: Column, raw: Column) -> Column:
    return F.when((x == 0.0) & (y == 0.0), F.lit(0.0)).otherwise(normalize_bearing(raw))


def haversine_nm(lat1, lon1, lat2, lon2) -> Column:
    return _distance_nm(_half_chord(_between(lat1, lon1, lat2, lon2)))


def haversine_of(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """:func:`haversine_nm` of arrays."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    half_lat, half_lon = np.sin((p2 - p1) / 2.0), np.sin(np.radians(lon2 - lon1) / 2.0)
    a = half_lat * half_lat + np.cos(p1) * np.cos(p2) * half_lon * half_lon
    return np.arcsin(np.clip(np.sqrt(a), 0.0, 1.0)) * (2.0 * EARTH_RADIUS_NM)


def initial_bearing(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle departure bearing; coincident points give 0."""
    x, y = _heading(_between(lat1, lon1, lat2, lon2))
    return _bearing(x, y, F.degrees(F.atan2(y, x)))


def _arc(lat, bearing, distance_nm) -> dict[str, Column]:
    """Sines and cosines that the end of a great-circle leg is made of."""
    p, th, d = F.radians(col(lat)), F.radians(col(bearing)), col(distance_nm) / EARTH_RADIUS_NM
    return {"sin_p": F.sin(p), "cos_p": F.cos(p), "sin_d": F.sin(d), "cos_d": F.cos(d), "sin_th": F.sin(th), "cos_th": F.cos(th)}


def _arc_sine(a: dict[str, Column]) -> Column:
    return clamp(a["sin_p"] * a["cos_d"] + a["cos_p"] * a["sin_d"] * a["cos_th"], -1.0, 1.0)


def _arc_lat(a: dict[str, Column]) -> Column:
    return F.degrees(F.asin(_arc_sine(a)))


def _arc_lon(lon, a: dict[str, Column]) -> Column:
    turn = F.atan2(a["sin_th"] * a["sin_d"] * a["cos_p"], a["cos_d"] - a["sin_p"] * _arc_sine(a))
    return wrap_longitude(F.degrees(F.radians(col(lon)) + turn))


def destination_lat(lat, bearing, distance_nm) -> Column:
    return _arc_lat(_arc(lat, bearing, distance_nm))


def destination_lon(lat, lon, bearing, distance_nm) -> Column:
    return _arc_lon(lon, _arc(lat, bearing, distance_nm))


def destination_point(lat, lon, bearing, distance_nm) -> Column:
    """Struct<lat, lon> reached along a great circle; lon in [-180, 180)."""
    return F.struct(
        destination_lat(lat, bearing, distance_nm).alias("lat"),
        destination_lon(lat, lon, bearing, distance_nm).alias("lon"),
    )


def enu_east(ref_lat, ref_lon, lat, lon) -> Column:
    mean = F.radians((col(ref_lat) + col(lat)) / 2.0)
    return F.radians(wrap_longitude(col(lon) - col(ref_lon))) * F.cos(mean) * EARTH_RADIUS_NM


def enu_north(ref_lat, lat) -> Column:
    return F.radians(col(lat) - col(ref_lat)) * EARTH_RADIUS_NM


def to_local_enu(ref_lat, ref_lon, lat, lon) -> Column:
    """Struct<east, north> on the mean-latitude tangent plane, date-line safe."""
    return F.struct(
        enu_east(ref_lat, ref_lon, lat, lon).alias("east"), enu_north(ref_lat, lat).alias("north")
    )


def from_local_enu(ref_lat, ref_lon, east, north) -> Column:
    """Inverse of :func:`to_local_enu`; at a pole the reference longitude is kept."""
    lat = col(ref_lat) + F.degrees(col(north) / EARTH_RADIUS_NM)
    c = F.cos(F.radians((col(ref_lat) + lat) / 2.0))
    lon = wrap_longitude(col(ref_lon) + F.degrees(col(east) / (c * EARTH_RADIUS_NM)))
    return F.struct(
        lat.alias("lat"),
        F.when(F.abs(c) < POLE_COSINE, col(ref_lon)).otherwise(lon).alias("lon"),
    )


def project_forward(lat, lon, track_deg, speed_kt, seconds) -> Column:
    """Dead-reckoned position after holding track and speed."""
    return destination_point(lat, lon, track_deg, knots_to_nm_per_second(speed_kt) * col(seconds))


def dead_reckoned_altitude(altitude_ft, vertical_rate_fpm, seconds) -> Column:
    return at_least(col(altitude_ft) + fpm_to_ft_per_second(vertical_rate_fpm) * col(seconds), 0.0)


def constant_turn(lat, lon, track_deg, speed_kt, turn_rate_deg_s, seconds) -> Column:
    """Struct<lat, lon> after holding speed and turn rate, in twelve mid-heading legs."""
    dt = col(seconds) / float(TURN_LEGS)
    leg = knots_to_nm_per_second(speed_kt) * dt
    rate = col(turn_rate_deg_s)
    start = F.struct(
        col(lat).cast("double").alias("lat"),
        col(lon).cast("double").alias("lon"),
        col(track_deg).cast("double").alias("hdg"),
    )

    def fly(s: Column, _leg: Column) -> Column:
        mid = normalize_bearing(s["hdg"] + rate * dt / 2.0)
        return F.struct(
            destination_lat(s["lat"], mid, leg).alias("lat"),
            destination_lon(s["lat"], s["lon"], mid, leg).alias("lon"),
            normalize_bearing(s["hdg"] + rate * dt).alias("hdg"),
        )

    flown = F.aggregate(F.sequence(F.lit(1), F.lit(TURN_LEGS)), start, fly)
    straight = project_forward(lat, lon, track_deg, speed_kt, seconds)
    return F.when(F.abs(rate) < STEADY_TURN_DEG_S, straight).otherwise(
        F.struct(flown["lat"].alias("lat"), flown["lon"].alias("lon"))
    )


def _destination_of(lat: np.ndarray, lon: np.ndarray, bearing: np.ndarray, distance_nm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`destination_point` of arrays."""
    p, th, d = np.radians(lat), np.radians(bearing), distance_nm / EARTH_RADIUS_NM
    sin_p, cos_p, sin_d, cos_d = np.sin(p), np.cos(p), np.sin(d), np.cos(d)
    sine = np.clip(sin_p * cos_d + cos_p * sin_d * np.cos(th), -1.0, 1.0)
    turn = np.arctan2(np.sin(th) * sin_d * cos_p, cos_d - sin_p * sine)
    return np.degrees(np.arcsin(sine)), np.mod(np.degrees(np.radians(lon) + turn) + 180.0, 360.0) - 180.0


@F.arrow_udf(StructType([StructField("lat", DoubleType()), StructField("lon", DoubleType())]))
def constant_turn_of(lat: pa.Array, lon: pa.Array, track_deg: pa.Array, speed_kt: pa.Array, turn_rate_deg_s: pa.Array, seconds: pa.Array) -> pa.Array:
    """:func:`constant_turn` of double columns, a batch at a time: a leg is flown by all rows at once."""
    given = [lat, track_deg, speed_kt, turn_rate_deg_s, seconds]
    unknown = np.any([c.is_null().to_numpy(zero_copy_only=False) for c in given], axis=0)
    y, hdg, speed, rate, span, x = (c.to_numpy(zero_copy_only=False) for c in (*given, lon))
    dt = span / float(TURN_LEGS)
    leg = speed / 3600.0 * dt
    straight = _destination_of(y, x, hdg, speed / 3600.0 * span)
    for _ in range(TURN_LEGS):
        y, x = _destination_of(y, x, np.mod(hdg + rate * dt / 2.0, 360.0), leg)
        hdg = np.mod(hdg + rate * dt, 360.0)
    steady = np.abs(rate) < STEADY_TURN_DEG_S
    ends = [np.where(steady, s, flown) for s, flown in zip(straight, (y, x))]
    masks = unknown, unknown | lon.is_null().to_numpy(zero_copy_only=False)
    return pa.StructArray.from_arrays([pa.array(e, pa.float64(), mask=m) for e, m in zip(ends, masks)], ["lat", "lon"])


def persistence_residual(speed_kt, vertical_rate_fpm, seconds) -> Column:
    """Struct<along, cross, alt>: standing still, relative to dead reckoning."""
    return F.struct(
        (-knots_to_nm_per_second(speed_kt) * col(seconds)).alias("along"),
        F.lit(0.0).alias("cross"),
        (-fpm_to_ft_per_second(vertical_rate_fpm) * col(seconds)).alias("alt"),
    )


def constant_turn_residual(speed_kt, turn_rate_deg_s, seconds) -> Column:
    """Struct<along, cross, alt>: a circular arc relative to dead reckoning."""
    v, w = knots_to_nm_per_second(speed_kt), F.radians(col(turn_rate_deg_s))
    theta = w * col(seconds)
    turning = F.abs(w) > FLAT_TURN_RAD_S
    radius = v / F.when(turning, w).otherwise(F.lit(1.0))
    return F.struct(
        F.when(turning, radius * F.sin(theta) - v * col(seconds)).otherwise(0.0).alias("along"),
        F.when(turning, radius * (1.0 - F.cos(theta))).otherwise(0.0).alias("cross"),
        F.lit(0.0).alias("alt"),
    )


def along_cross_error(ref_lat, ref_lon, lat, lon, track_deg) -> Column:
    """Struct<along, cross> of an actual point relative to a predicted one."""
    dist = haversine_nm(ref_lat, ref_lon, lat, lon)
    rel = F.radians(initial_bearing(ref_lat, ref_lon, lat, lon) - col(track_deg))
    near = dist < COINCIDENT_NM
    return F.struct(
        F.when(near, 0.0).otherwise(dist * F.cos(rel)).alias("along"),
        F.when(near, 0.0).otherwise(dist * F.sin(rel)).alias("cross"),
    )


def apply_along_cross(ref_lat, ref_lon, along_nm, cross_nm, track_deg) -> Column:
    """Inverse of :func:`along_cross_error`: Struct<lat, lon>."""
    dist = F.hypot(col(along_nm), col(cross_nm))
    brg = normalize_bearing(col(track_deg) + F.degrees(F.atan2(col(cross_nm), col(along_nm))))
    moved = destination_point(ref_lat, ref_lon, brg, dist)
    still = F.struct(col(ref_lat).alias("lat"), col(ref_lon).alias("lon"))
    return F.when(dist < COINCIDENT_NM, still).otherwise(moved)


# The same expressions over rows. Each sine is worked out once: copied into every place that uses it, an expression
# outgrows what the JVM compiles, and the generated code then runs interpreted.


def _held(df: DataFrame, name: str, values: dict[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
    out = computed_once(df, name, F.struct(*[v.alias(k) for k, v in values.items()]))
    return out, {k: F.col(f"{name}.{k}") for k in values}


def with_destination(df: DataFrame, name: str, lat, lon, bearing, distance_nm) -> DataFrame:
    """Rows with :func:`destination_point` as a column."""
    out, a = _held(df, "_arc", _arc(lat, bearing, distance_nm))
    return computed_once(out, name, F.struct(_arc_lat(a).alias("lat"), _arc_lon(lon, a).alias("lon"))).drop("_arc")


def with_projected(df: DataFrame, name: str, lat, lon, track_deg, speed_kt, seconds) -> DataFrame:
    """Rows with :func:`project_forward` as a column."""
    return with_destination(df, name, lat, lon, track_deg, knots_to_nm_per_second(speed_kt) * col(seconds))


def with_haversine(df: DataFrame, name: str, lat1, lon1, lat2, lon2) -> DataFrame:
    """Rows with :func:`haversine_nm` as a column."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    sines = {"half_lat": F.sin((p2 - p1) / 2.0), "half_lon": F.sin(F.radians(col(lon2) - col(lon1)) / 2.0), "cos1": F.cos(p1), "cos2": F.cos(p2)}
    out, b = _held(df, "_sines", sines)
    out = computed_once(out, "_chord", _half_chord(b))
    return computed_once(out, name, _distance_nm(F.col("_chord"))).drop("_sines", "_chord")


def with_along_cross(df: DataFrame, name: str, ref_lat, ref_lon, lat, lon, track_deg) -> DataFrame:
    """Rows with :func:`along_cross_error` as a column."""
    out, b = _held(df, "_sines", _between(ref_lat, ref_lon, lat, lon))
    x, y = _heading(b)
    out, v = _held(out, "_way", {"chord": _half_chord(b), "x": x, "y": y, "raw": F.degrees(F.atan2(y, x))})
    out, w = _held(out, "_polar", {"dist": _distance_nm(v["chord"]), "rel": F.radians(_bearing(v["x"], v["y"], v["raw"]) - col(track_deg))})
    near = w["dist"] < COINCIDENT_NM
    error = F.struct(
        F.when(near, 0.0).otherwise(w["dist"] * F.cos(w["rel"])).alias("along"),
        F.when(near, 0.0).otherwise(w["dist"] * F.sin(w["rel"])).alias("cross"),
    )
    return computed_once(out, name, error).drop("_sines", "_way", "_polar")


def with_applied(df: DataFrame, name: str, ref_lat, ref_lon, along_nm, cross_nm, track_deg) -> DataFrame:
    """Rows with :func:`apply_along_cross` as a column."""
    raw = col(track_deg) + F.degrees(F.atan2(col(cross_nm), col(along_nm)))
    out, w = _held(df, "_polar", {"dist": F.hypot(col(along_nm), col(cross_nm)), "bearing": normalize_bearing(raw)})
    out = with_destination(out, "_moved", ref_lat, ref_lon, w["bearing"], w["dist"])
    still = F.struct(col(ref_lat).alias("lat"), col(ref_lon).alias("lon"))
    return out.withColumn(name, F.when(w["dist"] < COINCIDENT_NM, still).otherwise(F.col("_moved"))).drop("_polar", "_moved")


def round_scaled(x, digits: int) -> Column:
    """Round as SQL engines do, on the scaled binary value: 40.75355 is below its tie, though it prints as one."""
    c, scale = col(x), 10.0**digits
    return F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale


def snapped_origin(lat, lon) -> Column:
    """Struct<lat, lon> tangent-plane origin on a whole degree (ties to even)."""
    return F.struct(F.bround(col(lat), 0).alias("lat"), F.bround(col(lon), 0).alias("lon"))


def track_id(icao24) -> Column:
    return F.concat(F.lit("trk-"), F.col(icao24) if isinstance(icao24, str) else icao24)


def flight_phase(vertical_rate_fpm, heading_error_deg) -> Column:
    vr = col(vertical_rate_fpm)
    return (
        F.when(vr > 300.0, "climb")
        .when(vr < -300.0, "descent")
        .when(F.abs(col(heading_error_deg)) > 1.0, "turn")
        .otherwise("cruise")
    )

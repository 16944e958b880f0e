"""The scalar functions for SQL users: `register(spark)` adds them to a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from wakeline.functions import probability as pr
from wakeline.functions.geo import COINCIDENT_NM, EARTH_RADIUS_NM, FLAT_TURN_RAD_S, POLE_COSINE

# Parameters are prefixed so that they can never capture a column.
_R = f"{EARTH_RADIUS_NM}D"


def _wrap(lon: str) -> str:
    return f"(pmod({lon} + 180.0D, 360.0D) - 180.0D)"


def _bearing(deg: str) -> str:
    return f"(CASE WHEN pmod({deg}, 360.0D) >= 360.0D THEN 0.0D ELSE pmod({deg}, 360.0D) END)"


def _haversine(a: str, b: str, c: str, d: str) -> str:
    inner = f"pow(sin(radians({c} - {a}) / 2.0D), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2.0D), 2)"
    return f"(2.0D * {_R} * asin(least(1.0D, sqrt({inner}))))"


def _initial(a: str, b: str, c: str, d: str) -> str:
    y = f"(sin(radians({d} - {b})) * cos(radians({c})))"
    x = f"(cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})))"
    return f"(CASE WHEN {x} = 0.0D AND {y} = 0.0D THEN 0.0D ELSE {_bearing(f'degrees(atan2({y}, {x}))')} END)"


def _destination(lat: str, lon: str, bearing: str, nm: str) -> str:
    s = f"greatest(-1.0D, least(1.0D, sin(radians({lat})) * cos({nm} / {_R}) + cos(radians({lat})) * sin({nm} / {_R}) * cos(radians({bearing}))))"
    turn = f"atan2(sin(radians({bearing})) * sin({nm} / {_R}) * cos(radians({lat})), cos({nm} / {_R}) - sin(radians({lat})) * {s})"
    return f"named_struct('lat', degrees(asin({s})), 'lon', {_wrap(f'degrees(radians({lon}) + {turn})')})"


_PLACE = "STRUCT<lat: DOUBLE, lon: DOUBLE>"
_POINTS = "p_lat1 DOUBLE, p_lon1 DOUBLE, p_lat2 DOUBLE, p_lon2 DOUBLE"
_ENDS = ("p_lat1", "p_lon1", "p_lat2", "p_lon2")
_BACK = f"(p_lat + degrees(p_north / {_R}))"
_COS = f"cos(radians((p_lat + {_BACK}) / 2.0D))"
_OFF = f"radians({_initial(*_ENDS)} - p_track)"
_V, _W = "(p_kt / 3600.0D)", "radians(p_turn)"

#: name(parameters) -> type, body
_SQL = {
    "knots_to_nm_per_second(p_kt DOUBLE)": ("DOUBLE", "p_kt / 3600.0D"),
    "fpm_to_ft_per_second(p_fpm DOUBLE)": ("DOUBLE", "p_fpm / 60.0D"),
    "normalize_bearing(p_deg DOUBLE)": ("DOUBLE", _bearing("p_deg")),
    "bearing_difference(p_from DOUBLE, p_to DOUBLE)": (
        "DOUBLE", "CASE WHEN pmod(p_to - p_from + 180.0D, 360.0D) = 0.0D THEN 180.0D ELSE pmod(p_to - p_from + 180.0D, 360.0D) - 180.0D END",
    ),
    f"haversine_nm({_POINTS})": ("DOUBLE", _haversine(*_ENDS)),
    f"initial_bearing({_POINTS})": ("DOUBLE", _initial(*_ENDS)),
    "destination_point(p_lat DOUBLE, p_lon DOUBLE, p_bearing DOUBLE, p_nm DOUBLE)": (_PLACE, _destination("p_lat", "p_lon", "p_bearing", "p_nm")),
    f"to_local_enu({_POINTS})": (
        "STRUCT<east: DOUBLE, north: DOUBLE>",
        f"named_struct('east', radians({_wrap('(p_lon2 - p_lon1)')}) * cos(radians((p_lat1 + p_lat2) / 2.0D)) * {_R}, 'north', radians(p_lat2 - p_lat1) * {_R})",
    ),
    "from_local_enu(p_lat DOUBLE, p_lon DOUBLE, p_east DOUBLE, p_north DOUBLE)": (
        _PLACE,
        f"named_struct('lat', {_BACK}, 'lon', CASE WHEN abs({_COS}) < {POLE_COSINE}D THEN p_lon ELSE {_wrap(f'p_lon + degrees(p_east / ({_COS} * {_R}))')} END)",
    ),
    "project_forward(p_lat DOUBLE, p_lon DOUBLE, p_track DOUBLE, p_kt DOUBLE, p_s DOUBLE)": (_PLACE, _destination("p_lat", "p_lon", "p_track", f"({_V} * p_s)")),
    "dead_reckoned_altitude(p_ft DOUBLE, p_fpm DOUBLE, p_s DOUBLE)": (
        "DOUBLE", "CASE WHEN p_ft + p_fpm / 60.0D * p_s < 0.0D THEN 0.0D ELSE p_ft + p_fpm / 60.0D * p_s END",
    ),
    "constant_turn_residual(p_kt DOUBLE, p_turn DOUBLE, p_s DOUBLE)": (
        "STRUCT<along: DOUBLE, cross: DOUBLE, alt: DOUBLE>",
        f"CASE WHEN abs({_W}) > {FLAT_TURN_RAD_S}D THEN named_struct('along', {_V} / {_W} * sin({_W} * p_s) - {_V} * p_s,"
        f" 'cross', {_V} / {_W} * (1.0D - cos({_W} * p_s)), 'alt', 0.0D) ELSE named_struct('along', 0.0D, 'cross', 0.0D, 'alt', 0.0D) END",
    ),
    "persistence_residual(p_kt DOUBLE, p_fpm DOUBLE, p_s DOUBLE)": (
        "STRUCT<along: DOUBLE, cross: DOUBLE, alt: DOUBLE>", f"named_struct('along', -{_V} * p_s, 'cross', 0.0D, 'alt', -p_fpm / 60.0D * p_s)",
    ),
    f"along_cross_error({_POINTS}, p_track DOUBLE)": (
        "STRUCT<along: DOUBLE, cross: DOUBLE>",
        f"CASE WHEN {_haversine(*_ENDS)} < {COINCIDENT_NM}D THEN named_struct('along', 0.0D, 'cross', 0.0D)"
        f" ELSE named_struct('along', {_haversine(*_ENDS)} * cos({_OFF}), 'cross', {_haversine(*_ENDS)} * sin({_OFF})) END",
    ),
    "snapped_origin(p_lat DOUBLE, p_lon DOUBLE)": (_PLACE, "named_struct('lat', bround(p_lat, 0), 'lon', bround(p_lon, 0))"),
    "track_id(p_icao24 STRING)": ("STRING", "concat('trk-', p_icao24)"),
    "flight_phase(p_fpm DOUBLE, p_off_deg DOUBLE)": (
        "STRING", "CASE WHEN p_fpm > 300.0D THEN 'climb' WHEN p_fpm < -300.0D THEN 'descent' WHEN abs(p_off_deg) > 1.0D THEN 'turn' ELSE 'cruise' END",
    ),
    "projected_sigma(p_a DOUBLE, p_b DOUBLE, p_ra DOUBLE, p_rb DOUBLE, p_t DOUBLE)": ("DOUBLE", "sqrt(p_a * p_a + p_b * p_b + (p_ra * p_ra + p_rb * p_rb) * p_t * p_t)"),
    "conflict_severity(p_time_to_cpa_s DOUBLE)": ("STRING", "CASE WHEN p_time_to_cpa_s <= 60.0D THEN 'warning' WHEN p_time_to_cpa_s <= 180.0D THEN 'caution' ELSE 'advisory' END"),
}
_PYTHON = {"disc_probability": pr.disc_probability, "band_probability": pr.band_probability, "conflict_probability": pr.conflict_probability}


def register(spark: SparkSession) -> list[str]:
    """Create temporary SQL functions; only the tail integrals are Python."""
    for signature, (returns, body) in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {returns} RETURN {body}")
    for name, function in _PYTHON.items():
        spark.udf.register(name, function)
    return [s.split("(")[0] for s in _SQL] + list(_PYTHON)

"""Curated situations end to end: reports in, alerts out; and SQL functions."""

import math

import pytest
from pyspark.sql import functions as F

from wakeline.functions import sql
from wakeline.plans import live
from wakeline.sources import traffic

US, T0 = 1_000_000, traffic.EPOCH_US
COLS = ("scenario_id string, icao24 string, report_id string, t_us long, lat double, lon double, altitude_baro_ft double, "
        "ground_speed_kt double, track_deg double, vertical_rate_fpm double, callsign string, squawk string")


def fly(icao, lat, lon, gs, trk, alt, seconds, turn=None):
    """One report per second along a track, optionally turning at a time to a heading."""
    rows, hdg = [], trk
    for t in range(seconds):
        rows.append(("s", icao, f"{icao}{t}", T0 + t * US, lat, lon, float(alt), float(gs), hdg % 360.0, 0.0, icao, None))
        if turn and t >= turn[0]:
            d = (turn[1] - hdg + 180.0) % 360.0 - 180.0
            hdg += max(-3.0, min(3.0, d))
        step = gs / 3600.0 / 60.0
        lat += step * math.cos(math.radians(hdg))
        lon += step * math.sin(math.radians(hdg)) / math.cos(math.radians(lat))
    return rows


def alerts_of(spark, rows, seconds):
    s = live.sky(spark.createDataFrame(rows, COLS), until_us=T0 + (seconds - 1) * US, lifecycle=False)
    new = live.alert_stream(s).where("state = 'new'").select("kind", "track_ids", ((F.col("raised_us") - T0) / US).alias("at"))
    return {(r.kind, tuple(r.track_ids)): r["at"] for r in new.collect()}


def test_head_on_pair_alerts_and_crossing_traffic_does_not(spark):
    rows = (fly("a1b2c3", 40.60, -76.81, 450, 90, 35000, 300) + fly("d4e5f6", 40.60, -74.19, 450, 270, 35000, 300)
            + fly("0a1b2c", 39.66667, -75.50, 420, 0, 39000, 300) + fly("3d4e5f", 41.30, -76.50, 440, 90, 35000, 300))
    found = alerts_of(spark, rows, 300)
    assert set(found) == {("predicted_conflict", ("trk-a1b2c3", "trk-d4e5f6"))}
    assert 140 <= found["predicted_conflict", ("trk-a1b2c3", "trk-d4e5f6")] <= 175


def test_unannounced_turn_raises_one_advisory(spark):
    rows = fly("c0ffee", 40.0, -76.5, 450, 90, 35000, 300, turn=(150, 10.0)) + fly("00000a", 42.0, -76.0, 430, 90, 33000, 300) + fly("00000b", 38.0, -74.0, 430, 270, 31000, 300)
    found = alerts_of(spark, rows, 300)
    assert set(found) == {("non_conformance", ("trk-c0ffee",))} and found["non_conformance", ("trk-c0ffee",)] > 150


def test_quiet_cruise_stays_silent(spark):
    rows = [r for i in range(6) for r in fly(f"00000{i}", 38.0 + i, -78.0 + 0.5 * i, 430 + i, 90, 31000 + 1500 * i, 150)]
    assert alerts_of(spark, rows, 150) == {}


def test_sql_functions(spark):
    assert len(set(sql.register(spark))) == 22
    r = spark.sql("select haversine_nm(0.0, 0.0, 0.0, 1.0), bearing_difference(350.0, 10.0), bearing_difference(0.0, 180.0), normalize_bearing(-10.0), "
                  "conflict_severity(61.0), disc_probability(0.0D, 5.0D, 2.0D)").first()
    assert r[0] == pytest.approx(60.04, abs=0.01) and tuple(r[1:5]) == (20.0, 180.0, 350.0, "caution") and r[5] == pytest.approx(1 - math.exp(-3.125))


def test_entry_and_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 120

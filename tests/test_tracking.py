"""Track estimation: filter arithmetic, lifecycle rules, and long flights."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.functions import kalman as kf
from wakeline.operators import tracking
from wakeline.sources import traffic

US = 1_000_000
T0 = traffic.EPOCH_US
COLS = ("scenario_id string, icao24 string, report_id string, t_us long, lat double, lon double, altitude_baro_ft double, "
        "ground_speed_kt double, track_deg double, vertical_rate_fpm double, callsign string, squawk string")


def report(t, lat=40.6, lon=-75.5, alt=35000.0, gs=450.0, trk=90.0, vr=0.0, icao="aaaaaa", cs="AB1", sq=None, rid=None):
    return ("s", icao, rid or f"r{t}", T0 + int(t * US), lat, lon, alt, gs, trk, vr, cs, sq)


def run(spark, rows, **kw):
    return tracking.track_updates(spark.createDataFrame(rows, COLS), **kw).orderBy("t_us").collect()


def test_split_filter_equals_six_state_filter():
    """The 2x2 arithmetic against the textbook six-state filter, with missing fields."""
    rng = np.random.default_rng(3)
    t = kf.Tuning()
    x0 = np.array([1.0, -2.0, 300.0, 200.0, 30000.0, 500.0])
    m0 = kf.Measured(*[np.array([v]) for v in x0])
    bank = kf.initial(m0, t)
    x, p = x0.copy(), np.diag([1.0, 1.0, 2500.0, 2500.0, 200.0**2, 500.0**2])
    for _ in range(200):
        dt = float(rng.uniform(0.3, 9.0))
        f = np.eye(6)
        f[0, 2] = f[1, 3] = dt / 3600.0
        f[4, 5] = dt / 60.0
        q = np.zeros((6, 6))
        for a, b, u, s in ((0, 2, 1 / 3600.0, 3.0), (1, 3, 1 / 3600.0, 3.0), (4, 5, 1 / 60.0, 60.0)):
            g = np.zeros(6)
            g[a], g[b] = 0.5 * u * dt * dt, dt
            q += np.outer(g, g) * s * s
        x, p = f @ x, f @ p @ f.T + q
        z = x + rng.normal(0, [0.02, 0.02, 3, 3, 30, 100])
        has_v, has_z, has_w = rng.random(3) < 0.7
        mask = np.array([True, True, has_v, has_v, has_z, has_w])
        h = np.eye(6)[mask]
        r = np.diag(np.array([t.position_nm**2] * 2 + [4.0] * 2 + [625.0, 10000.0])[mask])
        k = p @ h.T @ np.linalg.inv(h @ p @ h.T + r)
        x, p = x + k @ (z[mask] - h @ x), (np.eye(6) - k @ h) @ p
        zz = np.where(mask, z, np.nan)
        kf.predict(bank, np.array([dt]), t)
        kf.correct(bank, kf.Measured(*[np.array([v]) for v in zz]), t)
        assert np.allclose(bank[0, :6], x, atol=1e-7)
        assert np.allclose(bank[0, [kf.HPP, kf.HPV, kf.HVV]], [p[0, 0], p[0, 2], p[2, 2]], rtol=1e-6, atol=1e-12)
        assert np.allclose(bank[0, [kf.ZPP, kf.ZPV, kf.ZVV]], [p[4, 4], p[4, 5], p[5, 5]], rtol=1e-6, atol=1e-9)


def test_one_flight_in_floats_equals_the_bank():
    rng = np.random.default_rng(8)
    n, t = 300, kf.Tuning()
    cols = [rng.normal(0, s, n) for s in (20, 20, 300, 300)] + [rng.normal(30000, 500, n), rng.normal(0, 800, n)]
    for c in (2, 4, 5):
        cols[c][rng.random(n) < 0.3] = np.nan
    cols[3][np.isnan(cols[2])] = np.nan
    m, dt = kf.Measured(*cols), rng.uniform(0.2, 9.0, n)
    bank = kf.initial(m.take(slice(0, 1)), t)
    got, surprise = kf.follow(bank[0], dt[1:], m.take(slice(1, n)), t)
    for i in range(1, n):
        kf.predict(bank, dt[i : i + 1], t)
        s = kf.correct(bank, m.take(slice(i, i + 1)), t)
        assert np.allclose(bank[0], got[i - 1], rtol=1e-9, atol=1e-9) and s[0] == pytest.approx(surprise[i - 1], rel=1e-9)


def test_confirmation_coasting_termination(spark):
    rows = run(spark, [report(t) for t in (0, 1, 2)], as_of_us=T0 + 60 * US)
    assert [(r.state, r.update_count) for r in rows] == [("initiating", 1), ("initiating", 2), ("confirmed", 3), ("coasting", 3), ("terminated", 3)]
    assert [(r.t_us - T0) / US for r in rows] == [0, 1, 2, 7, 32]
    assert rows[3].position_uncertainty_m > rows[2].position_uncertainty_m


def test_long_silence_starts_a_new_flight(spark):
    rows = run(spark, [report(0), report(1), report(31), report(32)], lifecycle=False)
    assert [r.update_count for r in rows] == [1, 2, 1, 2]
    assert run(spark, [report(0), report(29.9)], lifecycle=False)[1].update_count == 2


def test_duplicates_are_ignored(spark):
    base = [report(t) for t in range(6)]
    again = [report(3, gs=999.0, rid="zz"), report(3, gs=1.0, rid="zy")]
    a, b = run(spark, base, lifecycle=False), run(spark, base + again, lifecycle=False)
    assert [(r.t_us, r.ground_speed_kt) for r in a] == [(r.t_us, r.ground_speed_kt) for r in b]


def test_missing_fields(spark):
    rows = run(spark, [report(0), report(1, gs=None, trk=None), report(2, alt=None, vr=None)], lifecycle=False)
    assert len(rows) == 3 and rows[2].altitude_ft == pytest.approx(35000.0, abs=50)
    first = run(spark, [report(0, alt=None, gs=None, trk=None, vr=None)], lifecycle=False)[0]
    assert (first.altitude_ft, first.ground_speed_kt, first.vertical_rate_fpm) == (0.0, 0.0, 0.0)


def test_heading_across_north_is_not_a_turn(spark):
    lat = [40.0 + 450 / 3600 / 60 * t for t in range(40)]
    rows = run(spark, [report(t, lat=lat[t], trk=(350.0 + t) % 360.0) for t in range(40)], lifecycle=False)
    assert all(abs(r.turn_rate_deg_s) < 10.0 for r in rows[5:])


def test_squawk_and_callsign_carry_forward(spark):
    rows = run(spark, [report(0, sq="7700"), report(1, cs=None), report(40, cs=None)], lifecycle=False)
    assert (rows[1].squawk, rows[1].callsign) == ("7700", "AB1")
    assert (rows[2].squawk, rows[2].callsign) == (None, None)


def test_a_flight_cut_into_slices_gives_the_sequential_answer(spark, sf):
    reports = traffic.reports(spark, sf)
    # Make one aircraft hold most rows, with a 30 s silence inside.
    u = reports.where("icao24 in ('000000', '000007')").where(~F.col("t_us").between(T0 + 100 * US, T0 + 135 * US))
    more = u.withColumn("t_us", F.col("t_us") + 300 * US).withColumn("report_id", F.concat("report_id", F.lit("b")))
    rows = reports.where("icao24 = '000003'").unionByName(u).unionByName(more)
    kw = {"as_of_us": T0 + 700 * US}
    num = ["lat", "lon", "altitude_ft", "ground_speed_kt", "track_deg", "vertical_rate_fpm", "turn_rate_deg_s", "position_uncertainty_m",
           "velocity_uncertainty_kt", "altitude_uncertainty_ft", "vertical_rate_uncertainty_fpm", "innovation_nm"]
    cols = ["icao24", "t_us", "last_report_us", "segment_us", "state", "update_count", "callsign", "squawk", *[F.round(c, 5).alias(c) for c in num]]
    whole = tracking.track_updates(rows, rows_per_task=None, **kw).select(*cols)
    cut = tracking.track_updates(rows, rows_per_task=12, **kw).select(*cols)
    assert whole.count() > 200
    assert whole.exceptAll(cut).count() == 0 and cut.exceptAll(whole).count() == 0

"""Pair scans: boundary cases, and pruned joins against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.functions import probability as pr
from wakeline.operators import conflicts, truth

COLS = ("scenario_id string, tick_us long, track_id string, callsign string, lat double, lon double, altitude_ft double, ground_speed_kt double, "
        "track_deg double, vertical_rate_fpm double, update_count int, vanish_tick_us long, position_uncertainty_m double, "
        "velocity_uncertainty_kt double, altitude_uncertainty_ft double, vertical_rate_uncertainty_fpm double")
R = 3440.0695


def track(i, lat, lon, alt=35000.0, gs=450.0, trk=90.0, vr=0.0, n=50, sig=(40.0, 3.0, 30.0, 60.0), scenario="s"):
    return (scenario, 0, f"trk-{i:06x}", None, lat, lon, alt, gs, trk, vr, n, None, *sig)


def frame(spark, rows):
    return spark.createDataFrame(rows, COLS)


def head_on(spark, alt=35000.0, vr=0.0, dist=60.0, **kw):
    d = dist / 2 / 60.0 / math.cos(math.radians(40.0))
    return frame(spark, [track(1, 40.0, -75 - d, trk=90.0), track(2, 40.0, -75 + d, alt=alt, vr=vr, trk=270.0, **kw)])


def test_head_on_pair_conflicts_in_four_minutes(spark):
    (c,) = conflicts.predicted_conflicts(head_on(spark)).collect()
    assert c.time_to_cpa_s == pytest.approx(240, abs=2) and c.min_horizontal_nm < 0.1


@pytest.mark.parametrize("gap,found", [(4000.0, 0), (1000.0, 0), (999.0, 1), (900.0, 1)])
def test_vertical_standard_is_strict(spark, gap, found):
    assert conflicts.predicted_conflicts(head_on(spark, alt=35000.0 + gap)).count() == found


def test_lookahead_young_tracks_and_climbs(spark):
    far = head_on(spark, dist=90.0)
    assert conflicts.predicted_conflicts(far).count() == 0
    assert conflicts.predicted_conflicts(far, lookahead_s=600.0).count() == 1
    assert conflicts.predicted_conflicts(head_on(spark, n=4)).count() == 0
    assert conflicts.predicted_conflicts(head_on(spark, alt=31000.0, vr=1000.0)).count() == 1


def test_parallel_tracks(spark):
    def pair(gap_nm):
        return frame(spark, [track(1, 40.0, -75.0), track(2, 40.0 + gap_nm / 60.0, -75.0)])

    assert conflicts.predicted_conflicts(pair(10.0)).count() == 0
    (c,) = conflicts.predicted_conflicts(pair(3.0)).collect()
    assert c.time_to_cpa_s == 0.0 and c.min_horizontal_nm == pytest.approx(3.0, abs=0.01)


def test_diverging_pair_is_silent(spark):
    rows = [track(1, 40.0, -75.2, trk=270.0), track(2, 40.0, -74.8, trk=90.0)]
    assert conflicts.predicted_conflicts(frame(spark, rows)).count() == 0


def test_missing_uncertainty_falls_back_to_the_point_verdict(spark):
    bare = (40.0, None, None, None)
    hit = conflicts.probable_conflicts(head_on(spark, sig=bare), 0.99).collect()
    assert len(hit) == 1 and hit[0].probability is None
    assert conflicts.probable_conflicts(head_on(spark, alt=36000.0, sig=bare), 0.01).count() == 0
    with pytest.raises(ValueError):
        conflicts.probable_conflicts(head_on(spark), 0.0)


def sky(n, seed, spread=1.4):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        rows.append(track(
            i, 40.0 + rng.uniform(-spread, spread), -75.0 + rng.uniform(-spread, spread), alt=float(rng.uniform(30000, 36000)),
            gs=float(rng.uniform(0, 650) if i else 900.0), trk=float(rng.uniform(0, 360)), vr=float(rng.choice([0.0, 0.0, rng.uniform(-3000, 3000)])),
            sig=(float(rng.uniform(20, 400)), float(rng.uniform(1, 20)), float(rng.uniform(10, 200)), float(rng.uniform(20, 400)))))
    return rows


def brute(rows, lookahead, threshold=None):
    lat0, lon0 = np.mean([r[4] for r in rows]), np.mean([r[5] for r in rows])
    out = set()
    k = []
    for r in rows:
        e = math.radians((r[5] - lon0 + 180) % 360 - 180) * math.cos(math.radians((lat0 + r[4]) / 2)) * R
        h = math.radians(r[8])
        k.append((r[2], e, math.radians(r[4] - lat0) * R, r[7] * math.sin(h), r[7] * math.cos(h), r[6], r[9], r[12:16]))
    for i, a in enumerate(k):
        for b in k[i + 1:]:
            dz, dvz = b[5] - a[5], (b[6] - a[6]) / 60
            s = 0.0
            if threshold is not None:
                s = 9 * math.sqrt(a[7][2] ** 2 + b[7][2] ** 2 + ((a[7][3] / 60) ** 2 + (b[7][3] / 60) ** 2) * lookahead**2)
            if abs(dz) - abs(dvz) * lookahead - s >= 1000:
                continue
            re, rn, ve, vn = b[1] - a[1], b[2] - a[2], (b[3] - a[3]) / 3600, (b[4] - a[4]) / 3600
            v2 = ve * ve + vn * vn
            t = 0.0 if v2 < 1e-12 else max(0.0, min(lookahead, -(re * ve + rn * vn) / v2))
            mh, mv = math.hypot(re + ve * t, rn + vn * t), abs(dz + dvz * t)
            if threshold is None:
                hit = mh < 5 and mv < 1000
            else:
                sh = math.sqrt(((a[7][0] / 1852) ** 2 + (b[7][0] / 1852) ** 2) / 2 + ((a[7][1] / 3600) ** 2 + (b[7][1] / 3600) ** 2) * t * t)
                sv = math.sqrt(a[7][2] ** 2 + b[7][2] ** 2 + ((a[7][3] / 60) ** 2 + (b[7][3] / 60) ** 2) * t * t)
                p = pr.disc(np.array([mh]), np.array([5.0]), np.array([sh]))[0]
                p *= pr.band(np.array([mv]), np.array([1000.0]), np.array([sv]))[0]
                hit = p >= threshold
            if hit:
                out.add(tuple(sorted((a[0], b[0]))))
    return out


@pytest.mark.parametrize("n", [40, 150])
def test_pruned_scan_equals_brute_force(spark, n):
    rows = sky(n, n)
    got = conflicts.predicted_conflicts(frame(spark, rows), lookahead_s=[60.0, 120.0, 300.0]).collect()
    assert len(got) == len({(r.lookahead_s, r.first_track_id, r.second_track_id) for r in got})
    for look in (60.0, 120.0, 300.0):
        found = {(r.first_track_id, r.second_track_id) for r in got if r.lookahead_s == look}
        assert found == brute(rows, look) and found


def test_probable_scan_equals_brute_force_when_dense(spark):
    rows = sky(120, 9)
    got = conflicts.probable_conflicts(frame(spark, rows), [None, 0.01, 0.5]).collect()
    for level in (None, 0.01, 0.5):
        found = {(r.first_track_id, r.second_track_id) for r in got if r.threshold == level}
        assert found == brute(rows, 300.0, level) and found


def test_wide_and_fast_traffic_meets_once_in_many_squares(spark):
    rows = sky(140, 4, spread=5.0)
    rows = [(*r[:7], r[7] * (4.0 if i % 9 == 0 else 1.0), *r[8:]) for i, r in enumerate(rows)]
    got = conflicts.predicted_conflicts(frame(spark, rows)).collect()
    found = [(r.first_track_id, r.second_track_id) for r in got]
    assert len(found) == len(set(found)) and set(found) == brute(rows, 300.0) and found
    assert all(a < b for a, b in found)


def test_scan_size_counts_each_overlapping_pair_once(spark):
    rows = sky(150, 3)
    r = conflicts.scan_size(frame(spark, rows)).first()
    assert r.all_pairs == 150 * 149 // 2 and len(brute(rows, 300.0)) <= r.pairs_met < 0.7 * r.all_pairs
    r = conflicts.scan_size(frame(spark, rows), probabilistic=True).first()
    assert len(brute(rows, 300.0, 0.01)) <= r.pairs_met <= r.all_pairs


def test_callsigns_stay_with_their_tracks(spark):
    rows = [("s", 0, r[2], "c-" + r[2], *r[4:]) for r in sky(60, 8)]
    got = conflicts.predicted_conflicts(frame(spark, rows)).collect()
    assert got and all((r.first_callsign, r.second_callsign) == ("c-" + r.first_track_id, "c-" + r.second_track_id) for r in got)


def test_error_function_in_bulk():
    x = np.concatenate([np.linspace(-7, 7, 20_001), [0.0, 1e-9, -1e-9, np.inf, -np.inf]])
    assert np.abs(pr.erf(x) - [math.erf(v) for v in x]).max() < 3e-16


@pytest.mark.parametrize("level", [0.01, 0.5, 0.9, 1.0])
def test_a_level_leaves_out_no_pair_that_reaches_it(spark, level):
    rows = sky(90, 6)
    every = conflicts.scored_pairs(frame(spark, rows)).where(F.col("probability") >= level).count()
    assert conflicts.probable_conflicts(frame(spark, rows), level).where("probability is not null").count() == every


def test_disc_probability_against_its_definition():
    """Numerical integration of the Gaussian over the disc, and the limits."""
    rng = np.random.default_rng(0)
    for miss, sigma in ((0.0, 1.0), (3.0, 2.0), (5.0, 0.7), (9.0, 3.0), (4.2, 0.3)):
        x = rng.normal(miss, sigma, 400_000), rng.normal(0, sigma, 400_000)
        assert pr.disc([miss], [5.0], [sigma])[0] == pytest.approx(np.mean(np.hypot(*x) < 5.0), abs=4e-3)
    assert list(pr.disc([1.0, 6.0, 5.0, 1.0], [5.0, 5.0, 5.0, 0.0], [0.0, 0.0, 0.0, 1.0])) == [1.0, 0.0, 0.0, 0.0]
    assert pr.disc([0.0], [5.0], [2.0])[0] == pytest.approx(1 - math.exp(-0.5 * 2.5**2), abs=1e-13)


def test_truth_violations_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    pts = [("s", 0, f"{i:06x}", float(rng.uniform(-0.6, 0.6)), float((179.6 + rng.uniform(0, 0.9) + 180) % 360 - 180), float(rng.uniform(30000, 33000))) for i in range(120)]
    df = spark.createDataFrame(pts, "scenario_id string, sec int, icao24 string, lat double, lon double, altitude_ft double")
    got = truth.violations(df).select("first_icao24", "second_icao24").collect()
    want = set()
    for i, a in enumerate(pts):
        for b in pts[i + 1:]:
            p, q = math.radians(a[3]), math.radians(b[3])
            s = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[4] - a[4]) / 2) ** 2
            if 2 * R * math.asin(math.sqrt(s)) < 5 and abs(a[5] - b[5]) < 1000:
                want.add((a[2], b[2]))
    assert len(got) == len(want) and {tuple(r) for r in got} == want and want


def test_events_bridge_thirty_seconds_inclusive(spark):
    def events(secs):
        df = spark.createDataFrame([("s", t, "a", "b", 1.0, 2.0) for t in secs], "scenario_id string, sec int, first_icao24 string, second_icao24 string, horizontal_nm double, vertical_ft double")
        return truth.conflict_events(df).count()

    assert events([1, 2, 3]) == 1 and events([1, 31]) == 1 and events([1, 32]) == 2

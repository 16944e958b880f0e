"""Alerts, rules, conformance, quantiles, contracts, views and models on small inputs."""

import json
import math
import random
import tempfile

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.operators import alerts, bootstrap, conformance, features, rules, scoring, slices, telemetry, views
from wakeline.operators.quantiles import Quantile, quantiles
from wakeline.plans import training
from wakeline.sources import contracts, streams, traffic

US = 1_000_000


def det(spark, ticks, vanish=None, key="k"):
    rows = [("s", key, t * US, (vanish or {}).get(t), "predicted_conflict", "caution", "x", ["r"], ["trk-a", "trk-b"]) for t in ticks]
    return spark.createDataFrame(
        rows, "scenario_id string, alert_key string, tick_us long, vanish_tick_us long, kind string, severity string, summary string, "
        "reason_codes array<string>, track_ids array<string>")


def life(spark, ticks, vanish=None, last=100):
    a = alerts.lifecycle(det(spark, ticks, vanish), last_tick_us=last * US).orderBy("updated_us", "state").collect()
    return [(r.state, r.updated_us // US) for r in a]


@pytest.mark.parametrize("ticks,expected", [
    ([1], [("new", 1), ("cleared", 4)]),
    ([1, 2, 4], [("new", 1), ("cleared", 7)]),
    ([1, 4], [("new", 1), ("cleared", 7)]),
    ([1, 5], [("new", 1), ("cleared", 4), ("new", 5), ("cleared", 8)]),
    (list(range(1, 22)), [("new", 1), ("sustained", 11), ("sustained", 21), ("cleared", 24)]),
    ([1, 3, 5, 7, 9, 12, 13, 15, 17, 19, 21, 22], [("new", 1), ("sustained", 12), ("sustained", 22), ("cleared", 25)]),
])
def test_alert_lifecycle(spark, ticks, expected):
    assert life(spark, ticks) == expected


def test_vanished_member_clears_at_once(spark):
    assert life(spark, [1, 2], {2: 3 * US}) == [("new", 1), ("cleared", 3)]
    assert life(spark, [1, 2, 4], {2: 3 * US}) == [("new", 1), ("cleared", 3), ("new", 4), ("cleared", 7)]


def test_open_alert_is_not_cleared_after_the_last_scan(spark):
    assert life(spark, [1], last=3) == [("new", 1)]


def test_heartbeat_state_crosses_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert [t for s, t in life(spark, list(range(1, 60))) if s == "sustained"] == [11, 21, 31, 41, 51]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rules(spark):
    cols = "scenario_id string, tick_us long, track_id string, vanish_tick_us long, callsign string, icao24 string, squawk string, vertical_rate_fpm double, altitude_ft double"

    def found(sq, vr, alt):
        return rules.findings(spark.createDataFrame([("s", 0, "t", None, None, "abc", sq, vr, alt)], cols)).collect()

    assert [r.severity for r in found("7700", 0.0, 35000.0)] == ["warning"]
    assert found("7600", 0.0, 1.0)[0].reason_codes == ["squawk_7600_radio_failure"]
    assert [(r.severity, r.reason_codes) for r in found(None, -6000.0, 35000.0)] == [("caution", ["descent_rate_above_6000_fpm"])]
    assert [(r.severity, len(r.reason_codes)) for r in found("1200", -6500.0, 9000.0)] == [("warning", 2)]
    assert found("1200", -2999.0, 500.0) == [] and found("1200", -5999.0, 10000.0) == []
    assert found(None, -6500.4, 34567.0)[0].summary == "abc descending at 6,500 fpm through 34,567 ft"


def _straight(spark, times, jump_at=None):
    rows = []
    for t in times:
        lat = 40.0 + (1.0 if jump_at is not None and t >= jump_at else 0.0)
        rows.append(("s", "trk-a", "a", "AB", t * US, "confirmed", lat, -75.0, 30000.0, 0.0, 90.0, 0.0))
    return spark.createDataFrame(rows, "scenario_id string, track_id string, icao24 string, callsign string, t_us long, state string, lat double, lon double, "
                                 "altitude_ft double, ground_speed_kt double, track_deg double, vertical_rate_fpm double")


@pytest.mark.parametrize("slice_s", [3600.0, 100.0])
def test_predictions_mature_in_tolerance_and_not_across_gaps(spark, slice_s):
    u = _straight(spark, list(range(0, 100)), jump_at=80)
    m = conformance.matured(conformance.predictions(u), slice_s=slice_s).collect()
    assert len(m) == 43 and all(r.matched_us - r.predicted_us == 57 * US for r in m)
    assert sum(r.error_nm > 50 for r in m) == 20
    gap = _straight(spark, [*range(0, 30), *range(62, 92)])
    assert conformance.matured(conformance.predictions(gap), slice_s=slice_s).count() == 0


def test_thresholds(spark):
    df = spark.createDataFrame([("model",), ("dead_reckoning",)], "source string")
    assert [r[0] for r in df.select(conformance.threshold("source", 60.0)).collect()] == [pytest.approx(3.66), pytest.approx(7.236)]
    assert [r[0] for r in df.select(conformance.threshold("source", 45.0)).collect()] == [1.5, 1.5]


@pytest.mark.parametrize("width", [None, 0.05])
def test_quantiles_match_numpy(spark, width):
    rng = np.random.default_rng(1)
    data = {g: np.round(rng.normal(size=n), 3) for g, n in (("a", 1), ("b", 9), ("c", 10), ("d", 999), ("e", 1000))}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs], "g string, v double")
    q = quantiles(df, ["g"], "v", [Quantile("med", 0.5, "median"), Quantile("p10", 0.1, min_count=10), Quantile("p90", 0.9),
                                   Quantile("lin", 0.9, "linear"), Quantile("lo", 0.0), Quantile("hi", 1.0)], width=width)
    for r in q.collect():
        v = np.sort(data[r.g])
        n = len(v)
        assert r.n == n and r.med == pytest.approx(np.median(v)) and r.lin == pytest.approx(np.percentile(v, 90))
        assert r.lo == v[0] and r.hi == v[-1] and r.p90 == v[min(n - 1, 9 * n // 10)]
        assert (r.p10 is None) if n < 10 else r.p10 == v[n // 10]


def test_halo_windows_equal_plain_windows(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(int(t),) for t in np.unique(rng.integers(0, 5000, 900)) * US // 10], "t_us long").withColumn("k", F.lit("x"))
    from pyspark.sql import Window

    def near(w):
        prev = F.lag("t_us").over(w)
        return F.when(F.col("t_us") - prev <= 2 * US, prev)

    plain = df.withColumn("p", near(Window.partitionBy("k").orderBy("t_us")))
    cut = slices.drop_halo(slices.with_halo(df, before_s=2.0, slice_s=7.0).withColumn("p", near(slices.sliced_window("k"))))
    assert plain.exceptAll(cut).count() == 0 and cut.count() == plain.count()


def test_contracts_split_valid_from_dead(spark):
    good = {"schema_version": "v", "report_id": "r", "icao24": "abc123", "observed_at": "2024-01-01T00:00:00.000000Z", "lat": 1.0, "lon": 2.0, "on_ground": False, "source": "simulator"}
    bad = [dict(good, lat=91.0), dict(good, extra=1), {k: v for k, v in good.items() if k != "report_id"}, dict(good, icao24="XYZ"), dict(good, squawk="9999"),
           dict(good, track_deg=360.0), dict(good, ground_speed_kt=-1.0), dict(good, source="radar"), dict(good, lat="north")]
    text = [json.dumps(x) for x in [good, *bad]] + ["{not json", ""]
    p = contracts.parse(spark.createDataFrame([(t,) for t in text], "value string"), contracts.REPORTS)
    assert contracts.valid(p, contracts.REPORTS).count() == 1
    reasons = [r.reasons for r in p.select("reasons").collect()]
    assert reasons[0] == [] and all(reasons[1:])
    assert [r[0] for r in reasons[1:9]] == ["lat_range", "unknown_field", "missing_report_id", "icao24_pattern", "squawk_pattern", "track_deg_range", "ground_speed_range", "source_value"]
    assert contracts.dead_letters(p).count() == len(text) - 1


def test_messages_need_a_key_and_files_round_trip(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    with pytest.raises(Exception, match="key"):
        streams.to_messages(df, "k").collect()
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/m"
    streams.to_messages(df.where("k is not null"), "k").write.json(path)
    assert [r.key for r in streams.read_files(spark, path, streaming=False).collect()] == ["a"]
    streams.write_results(df, path + "r", "one", stamps={"detector": "v1"})
    assert {r.detector for r in spark.read.parquet(path + "r").collect()} == {"v1"}


def test_schema_drift(spark):
    cols = "table string, field string, type string, required boolean"
    old = spark.createDataFrame([("t", "a", "int", True), ("t", "b", "int", False), ("t", "c", "int", False), ("t", "d", "int", False)], cols)
    new = spark.createDataFrame([("t", "a", "string", True), ("t", "b", "int", True), ("t", "d", "int", False), ("t", "e", "int", False), ("t", "f", "int", True)], cols)
    got = {(r.field, r.change) for r in contracts.drift(old, new).collect()}
    assert got == {("a", "type_changed"), ("b", "newly_required"), ("c", "removed"), ("f", "newly_required")}


def test_upsert_keeps_first_seen_and_ignores_older_batches(spark):
    cols = "scenario_id string, track_id string, icao24 string, callsign string, t_us long, last_report_us long, state string, update_count int"
    first = spark.createDataFrame([("s", "t", "i", "A", 10, 10, "confirmed", 5)], cols)
    older = spark.createDataFrame([("s", "t", "i", "B", 5, 5, "initiating", 1), ("s", "u", "j", None, 6, 6, "initiating", 1)], cols)
    table = views.upsert_tracks(views.track_rows(first), older)
    assert {(r.track_id, r.callsign, r.first_seen_us, r.update_count) for r in table.collect()} == {("t", "A", 10, 5), ("u", None, 6, 1)}


def test_attribution_prefers_the_latest_manoeuvre(spark):
    m = spark.createDataFrame([("s", "a", 10.0, "TurnTo"), ("s", "a", 100.0, "ClimbTo"), ("s", "b", 0.0, "TurnTo")], "scenario_id string, icao24 string, at_s double, kind string")
    a = spark.createDataFrame([("s", "a", 99.0), ("s", "a", 150.0), ("s", "b", 241.0), ("s", "a", 5.0)], "scenario_id string, icao24 string, at_s double")
    got = {(r.icao24, r.at_s): (r.attributed, r.cause_kind, r.lag_s) for r in scoring.attribute(a, m).collect()}
    assert got == {("a", 99.0): (True, "TurnTo", 89.0), ("a", 150.0): (True, "ClimbTo", 50.0), ("b", 241.0): (False, None, None), ("a", 5.0): (False, None, None)}


def test_event_matching(spark):
    ev = spark.createDataFrame([("s", "a", "b", 1, 100)], "scenario_id string, first_icao24 string, second_icao24 string, event_no int, started_s int")

    def card(raised):
        r = spark.createDataFrame(raised, "scenario_id string, alert_key string, first_icao24 string, second_icao24 string, raised_us long")
        sc = spark.createDataFrame([("s", 3600.0)], "scenario_id string, duration_s double")
        return scoring.conflict_scorecard(ev, r, sc, 0).first()

    early, late, other = [("s", "k", "a", "b", 40 * US)], [("s", "k", "a", "b", 101 * US)], [("s", "k2", "a", "c", 1)]
    assert (lambda c: (c.recall, c.precision, c.lead_median_s))(card(early)) == (1.0, 1.0, 60.0)
    assert (lambda c: (c.recall, c.precision, c.lead_count))(card(late)) == (0.0, 1.0, 0)
    assert (lambda c: (c.recall, c.precision, c.false_alerts))(card(early + other)) == (1.0, 0.5, 1)


def test_bootstrap_picks_draw_as_many_as_there_are(spark):
    ids = spark.createDataFrame([(f"s{i}",) for i in range(37)], "scenario_id string")
    p = bootstrap.picks(ids, 50, 1)
    sums = {r.n for r in p.groupBy("b").agg(F.sum("times").alias("n")).collect()}
    assert sums == {37} and p.select("b").distinct().count() == 50


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 20)) * rng.uniform(0.5, 20, 20) + 3
    y = x @ rng.normal(size=(20, 3)) * 0.1 + rng.normal(size=(300, 3))
    df = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(x, y)], [*features.FEATURE_COLUMNS, *training.TARGETS])
    m = training.fit_ridge(df)
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + np.eye(20), z.T @ (y - y.mean(0)))
    for k, t in enumerate(training.TARGETS):
        assert np.allclose(list(m.coefficients()[t].values()), want[:, k], atol=1e-8)


def test_features_need_a_full_unbroken_window(spark):
    base = [("s", "t", i * US, float(i), 0.0, 0.0, 100.0, 90.0, 1.0, None) for i in range(25)]
    cols = "scenario_id string, track_id string, t_us long, ground_speed_kt double, vertical_rate_fpm double, turn_rate_deg_s double, altitude_ft double, track_deg double, position_uncertainty_m double, innovation_nm double"
    f = features.complete(features.with_features(spark.createDataFrame(base, cols)))
    assert f.count() == 6 and f.agg(F.max("f_speed_change_kt")).first()[0] == 19.0
    late = [(*r[:2], r[2] + (40 * US if i >= 10 else 0), *r[3:]) for i, r in enumerate(base)]
    assert features.complete(features.with_features(spark.createDataFrame(late, cols))).count() == 0
    nan = f.withColumn("f_innovation_nm", F.lit(float("nan")))
    with pytest.raises(ValueError, match="innovation_nm"):
        features.require_finite(nan)


def test_histogram_quantiles_interpolate(spark):
    df = spark.createDataFrame([(0.2,), (0.4,), (0.6,), (0.8,)], "v double").withColumn("d", F.lit("x"))
    h = telemetry.histogram(df, "v", "d", bounds=[0.5, 1.0])
    got = {r.q: r.value for r in telemetry.histogram_quantiles(h, "d", qs=(0.5, 0.75)).collect()}
    assert got == {0.5: 0.5, 0.75: 0.75}


def test_null_inputs_stay_null(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    r = df.select(geo.haversine_nm("a", "b", "b", "b"), geo.destination_lat("b", "a", "b"), geo.dead_reckoned_altitude("a", "b", 1.0)).first()
    assert tuple(r) == (None, None, None)


LAT, LON = st.floats(-80, 80), st.floats(-180, 179.99)


@settings(max_examples=2, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(LAT, LON, LAT, LON, st.floats(-1000, 1000), st.floats(0, 500)), min_size=1, max_size=60))
def test_geometry_properties(spark, rows):
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, h double, n double")
    p = df.withColumn("p", geo.destination_point("a", "b", "h", "n")).withColumn("q", geo.to_local_enu("a", "b", "p.lat", "p.lon"))
    r = p.select(
        F.max(F.abs(geo.haversine_nm("a", "b", "c", "d") - geo.haversine_nm("c", "d", "a", "b"))).alias("sym"),
        F.max(F.abs(geo.haversine_nm("a", "b", "p.lat", "p.lon") - F.col("n"))).alias("dist"),
        F.min(geo.normalize_bearing("h")).alias("lo"), F.max(geo.normalize_bearing("h")).alias("hi"),
        F.max(geo.haversine_nm("p.lat", "p.lon", geo.from_local_enu("a", "b", "q.east", "q.north")["lat"], geo.from_local_enu("a", "b", "q.east", "q.north")["lon"])).alias("trip"),
        F.max(F.abs("p.lon")).alias("wrap"),
    ).first()
    assert r.sym < 1e-6 and r.dist < 1e-4 and 0 <= r.lo and r.hi < 360 and r.trip < 1e-4 and r.wrap <= 180
    tiny = df.limit(1).select(geo.normalize_bearing(F.lit(-1e-64)), geo.bearing_difference(F.lit(350.0), F.lit(10.0)), geo.bearing_difference(F.lit(0.0), F.lit(180.0))).first()
    assert tuple(tiny) == (0.0, 20.0, 180.0)


def test_gauge_counts_what_holds_each_minute(spark):
    from wakeline.operators import telemetry

    rng = random.Random(4)
    rows = [(rng.choice("ab"), s := rng.randrange(0, 900) * 1_000_000, None if rng.random() < 0.1 else s + rng.randrange(0, 400) * 1_000_000) for _ in range(200)]
    got = telemetry.gauge(spark.createDataFrame(rows, "k string, s long, e long"), "s", "e", "k").collect()
    assert len(got) == len({(r.k, r.at_us) for r in got}) and {r.k for r in got} == {"a", "b"}
    for r in got:
        assert r.n == sum(k == r.k and s <= r.at_us and (e is None or e > r.at_us) for k, s, e in rows)
    for k in "ab":
        minutes = sorted(r.at_us // 60_000_000 for r in got if r.k == k)
        assert minutes == list(range(minutes[0], minutes[-1] + 1))


def test_binomial_quantiles_equal_summed_probabilities():
    rng = np.random.default_rng(1)
    n = np.array([0, 1, 5, 17, 40, 40, 200, 200])
    p = np.array([0.3, 0.5, 0.0, 1.0, 0.5, 0.03, 0.9, 1 / 3])
    for _ in range(50):
        u = rng.random(len(n))
        want = []
        for ui, ni, pi in zip(u, n, p):
            k, upto = 0, (1 - pi) ** ni
            while upto <= ui and k < ni:
                k += 1
                upto += math.comb(int(ni), k) * pi**k * (1 - pi) ** (ni - k)
            want.append(k)
        assert bootstrap.binomial_quantiles(u, n, p).tolist() == want
    big = bootstrap.binomial_quantiles(rng.random(2000), np.full(2000, 10_000_000), np.full(2000, 0.25))
    assert abs(big.mean() - 2_500_000) < 200 and 1200 < big.std() < 1540


def test_class_draws_are_multinomial(spark):
    sizes = [40, 1, 7, 2, 30]
    classes = spark.createDataFrame(list(enumerate(sizes)), "idx long, c long")
    rows = bootstrap.class_draws(classes, 2000, 5).collect()
    per = np.zeros((2000, len(sizes)))
    for r in rows:
        per[r.b, r.idx] += r.times
    assert (per.sum(1) == 80).all() and len(rows) <= 2000 * len(sizes)
    share = np.array(sizes) / 80
    assert np.allclose(per.mean(0), sizes, atol=0.4)
    cov = 80 * (np.diag(share) - np.outer(share, share))
    assert np.allclose(np.cov(per.T), cov, atol=1.6)
    assert bootstrap.class_draws(classes.limit(0), 10, 1).count() == 0
    assert {(r.b, r.times) for r in bootstrap.class_draws(classes.where("idx = 0"), 3, 1).collect()} == {(0, 40), (1, 40), (2, 40)}


def test_paired_interval_by_classes_is_that_of_scenarios(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        kind = int(rng.integers(0, 4))  # four different outcomes
        rows += [(f"s{i}", -1.0, 4, 1 + kind % 2), (f"s{i}", 0.5, 4, kind)]
    per = spark.createDataFrame(rows, "scenario_id string, threshold double, alerts long, false_alerts long")
    assert bootstrap.outcome_classes(per, "threshold").count() == 4
    got = bootstrap.paired_precision_delta(per, arm="threshold", baseline=F.col("threshold") == -1.0, resamples=4000).first()
    a, z = np.array([r[2:] for r in rows[1::2]]), np.array([r[2:] for r in rows[::2]])
    pick = rng.integers(0, 120, (4000, 120))
    deltas = (1 - a[pick, 1].sum(1) / a[pick, 0].sum(1)) - (1 - z[pick, 1].sum(1) / z[pick, 0].sum(1))
    assert np.allclose([got.ci95_low, got.ci95_high], np.quantile(deltas, [0.025, 0.975]), atol=0.012)
    assert got.precision_delta == round(float(z[:, 1].sum() - a[:, 1].sum()) / 480, 4) and got.iterations == 4000

"""Findings of the reviews, each on the smallest table that shows it."""

from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.plans import registered_inputs
from wakeline.plans.registered import load_all
from wakeline.sources import traffic

QUERIES = load_all()
SF01 = "/root/testdata/sf0.1"


def some_events(spark, folder, users):
    """A table folder with the events of a few users."""
    traffic.load(spark, SF01, "events").where(f"user_id in ({users})").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_trail_points_round_their_binary_value(spark, tmp_path):
    # A first report at 40.30255 degrees: the double lies below the tie it prints as.
    trail = QUERIES["f07_track_trails"](spark, some_events(spark, tmp_path, "1249")).first()["trail"]
    assert trail.startswith("40.3025@1704067206234498;")


def test_truth_is_spread_before_it_grows_to_a_row_a_second(spark, sf):
    # A row an aircraft fits one partition after the grouping; all its seconds were then one task's work.
    sizes = traffic.truth(spark, sf).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1


def test_geometry_over_rows_equals_its_expressions(spark):
    rows = spark.createDataFrame(
        [(40.0, -75.0, 41.0, -76.0, 10.0, 5.0), (40.0, -75.0, 40.0, -75.0, 200.0, 0.0), (0.0, 179.9, -1.0, -179.9, 359.0, 80.0), (None, 1.0, 2.0, 3.0, 4.0, 5.0)],
        "a double, b double, c double, d double, t double, n double",
    )
    wide = geo.with_destination(rows, "w1", "a", "b", "t", "n")
    wide = geo.with_haversine(wide, "w2", "a", "b", "c", "d")
    wide = geo.with_along_cross(wide, "w3", "a", "b", "c", "d", "t")
    wide = geo.with_applied(wide, "w4", "a", "b", "n", F.lit(1.5), "t")
    for r in wide.select(
        "w1", geo.destination_point("a", "b", "t", "n").alias("e1"), "w2", geo.haversine_nm("a", "b", "c", "d").alias("e2"),
        "w3", geo.along_cross_error("a", "b", "c", "d", "t").alias("e3"), "w4", geo.apply_along_cross("a", "b", "n", F.lit(1.5), "t").alias("e4"),
    ).collect():
        assert (r.w1, r.w2, r.w3, r.w4) == (r.e1, r.e2, r.e3, r.e4)


def test_no_part_of_a_streamed_table_is_one_task(spark):
    seen = []

    def each(batch, _):
        seen.append((batch.select(F.input_file_name()).distinct().count(), batch.agg(F.min("t"), F.max("t"), F.count("*")).first()))

    registered_inputs.streamed(None, spark.range(0, 4000, 1, 16).withColumnRenamed("id", "t"), "t", each=each)
    assert sum(r[2] for _, r in seen) == 4000 and len(seen) == 4
    assert all(a[1] < b[0] for (_, a), (_, b) in zip(seen, seen[1:]))
    assert all(files > 1 for files, _ in seen)


def test_alerts_of_other_kinds_scan_no_pairs(spark, monkeypatch):
    from wakeline.operators import conflicts
    from wakeline.plans.registered import QUERIES, load_all

    load_all()

    def scanned(*args, **kwargs):
        raise AssertionError("pairs were scanned")

    monkeypatch.setattr(conflicts, "predicted_conflicts", scanned)
    assert QUERIES["a12_alerts_of_kind"](spark, "/root/testdata/sf0.001").columns == ["scenario_id", "alert_key", "kind", "updated_us"]


def test_first_alerts_need_no_lifecycle(spark, monkeypatch):
    """Spells that end and open again, a vanishing, and several thresholds: the alert raised first is the pair's first conflict."""
    from wakeline.operators import alerts, scoring
    from wakeline.plans import evaluation

    ticks = {("trk-00000a", "trk-00000b"): [0, 1, 2, 9, 10, 30], ("trk-00000a", "trk-00000c"): [5], ("trk-00000b", "trk-00000c"): [3, 4, 40]}
    rows = [("s", t * 1_000_000, *p, None, None, 60.0 - t, 0.1 * t, 300.0, 7.0, 900.0, 300.0, 0.01 * (t + 1), 12_000_000 if t == 10 else None) for p, at in ticks.items() for t in at]
    found = spark.createDataFrame(
        rows, "scenario_id string, tick_us long, first_track_id string, second_track_id string, first_callsign string, second_callsign string,"
        " time_to_cpa_s double, min_horizontal_nm double, min_vertical_ft double, current_horizontal_nm double, current_vertical_ft double,"
        " lookahead_s double, probability double, vanish_tick_us long")
    levels = [0.01, 0.05, 0.30]
    each = found.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in levels]))).where("probability >= threshold")
    life = alerts.conflict_lifecycle(each, last_tick_us=60_000_000, by=["threshold"], sustain=False)
    wanted = sorted(scoring.first_raised(life, ["threshold"]).collect())
    called = []
    monkeypatch.setattr(alerts, "lifecycle", lambda *a, **k: called.append(a))
    got = evaluation.raised_alerts(found, verdicts={"threshold": {x: F.col("probability") >= x for x in levels}})
    assert sorted(got.collect()) == wanted and len(wanted) == 8 and not called
    renamed = found.withColumnRenamed("min_horizontal_nm", "min_horizontal_sep_nm")
    one = {tuple(r[:2]): r for r in evaluation.raised_alerts(renamed, evidence=["min_horizontal_sep_nm"]).collect()}
    assert len(one) == 3 and one["s", "predicted_conflict:trk-00000b:trk-00000c"].min_horizontal_sep_nm == 0.1 * 3


def test_pairs_folded_in_blocks_are_those_of_the_scan(spark):
    """Blocks of seven tracks and slices of two ticks give the scan's first conflicts, counts and soonest at each lookahead."""
    import numpy as np

    from wakeline.operators import conflicts, pair_blocks, picture

    rng = np.random.default_rng(5)
    rows = [(s, k * 1_000_000, f"trk-{i:06x}", 40.0 + float(y), -75.0 + float(x), float(z), float(g), float(h), float(v))
            for s in "ab" for k in range(5)
            for i, (y, x, z, g, h, v) in enumerate(zip(rng.uniform(-1, 1, 40), rng.uniform(-1, 1, 40), rng.uniform(30000, 34000, 40), rng.uniform(0, 600, 40), rng.uniform(0, 360, 40), rng.choice([0.0, 2000.0], 40)))]
    p = spark.createDataFrame(rows, "scenario_id string, tick_us long, track_id string, lat double, lon double, altitude_ft double, ground_speed_kt double, track_deg double, vertical_rate_fpm double")
    p = p.withColumns({"update_count": F.lit(9), "callsign": F.lit(None).cast("string"), "vanish_tick_us": F.lit(None).cast("long")}).cache()
    spans = [60.0, 300.0]
    scan = conflicts.predicted_conflicts(p, lookahead_s=spans).cache()
    framed = picture.in_shared_frame(picture.eligible(p))
    parts = pair_blocks.first_conflicts(framed, spans, 5.0, 1000.0, size=7, slice_s=2)
    ids = ["lookahead_s", "scenario_id", "first_track_id", "second_track_id"]

    def first(df):
        return sorted(df.groupBy(*ids).agg(F.min("tick_us"), F.round(F.min_by("min_horizontal_nm", "tick_us"), 6)).collect())

    assert first(parts) == first(scan) and len(first(scan)) > 100
    counted = pair_blocks.conflict_tallies(framed, spans, 5.0, 1000.0, size=7, slice_s=2).groupBy("lookahead_s").agg(F.sum("n"), F.round(F.min("time_to_cpa_s"), 6), F.min("first_us"))
    wanted = scan.groupBy("lookahead_s").agg(F.count("*"), F.round(F.min("time_to_cpa_s"), 6), F.min("tick_us"))
    assert sorted(counted.collect()) == sorted(wanted.collect())


def test_closest_approach_makes_no_row_a_second(spark):
    """Asked pairs of blocks of three and slices of 40 s equal the join by the second; a pair that never meets is left out."""
    from wakeline.operators import pair_blocks, truth

    rows = [("s", f"{i:06x}", t, 40.0 + 0.01 * i + 0.001 * t * (-1) ** i, -75.0 + 0.002 * t * i, 30000.0 + 400.0 * i) for i in range(7) for t in range(10 * i, 10 * i + 100 if i < 6 else 61)]
    rows.append(("s", "00000f", 500, 40.0, -75.0, 30000.0))
    t = spark.createDataFrame(rows, "scenario_id string, icao24 string, sec int, lat double, lon double, altitude_ft double").cache()
    ids = t.select("scenario_id", "icao24").distinct()
    pairs = ids.withColumnRenamed("icao24", "first_icao24").join(ids.withColumnRenamed("icao24", "second_icao24"), "scenario_id").where("first_icao24 < second_icao24")
    a = t.selectExpr("icao24 first_icao24", "sec", "lat la", "lon lo", "altitude_ft z")
    met = pairs.join(a, "first_icao24").join(t.withColumnRenamed("icao24", "second_icao24"), ["scenario_id", "second_icao24", "sec"])
    h, v = F.round(geo.haversine_nm("la", "lo", "lat", "lon"), 9), F.abs(F.col("z") - F.col("altitude_ft"))
    wanted = met.select(*truth.PAIR, "sec", h.alias("h"), v.alias("v")).groupBy(*truth.PAIR).agg(F.min("h"), F.min_by("v", F.struct("h", "sec")), F.bool_or(F.expr("h < 5 and v < 1000")))
    parts = pair_blocks.closest(t, pairs, 5.0, 1000.0, size=3, slice_s=40)
    got = parts.groupBy(*truth.PAIR).agg(F.round(F.min("h"), 9), F.min_by("v", F.struct("h", "sec")), F.bool_or("conflicted"))
    assert sorted(got.collect()) == sorted(wanted.collect()) and 15 < got.count() < pairs.count()
    assert truth.closest_approach(t, pairs).count() == got.count()

"""Scans along a key in slices give the answer of one window, wherever the slices are cut."""

import random

import pytest
from pyspark.sql import functions as F

from wakeline.operators import alerts, scoring, segments, truth

DETECTION = "arm double, scenario_id string, alert_key string, tick_us long, vanish_tick_us long, kind string, severity string, summary string, reason_codes string, track_ids array<string>"
S = 1_000_000


def detections(spark, seed, n=700):
    rng, rows = random.Random(seed), []
    for arm in (None, 0.5):
        for key in ("hot", "b", "c"):
            t = 0
            for _ in range(n if key == "hot" else 40):
                t += rng.choice([1, 1, 1, 1, 2, 3, 4, 5, 40]) if key != "hot" else rng.choice([1] * 60 + [2, 3, 4, 9])
                gone = (t + rng.choice([1, 2, 3])) * S if rng.random() < 0.05 else None
                rows.append((arm, "s", key, t * S, gone, "k", "advisory", f"at {t}", "r", ["x"]))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, DETECTION), rows


def folded(rows, last_us):
    """The lifecycle row by row."""
    out, by_key = set(), {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[3])):
        by_key.setdefault((r[0], r[2]), []).append((r[3], r[4]))
    for (arm, key), seen in by_key.items():
        raised = published = None
        for i, (t, gone) in enumerate(seen):
            before = seen[i - 1] if i else None
            if before is None or t - before[0] >= 4 * S or (before[1] is not None and before[1] < t):
                raised = published = t
                out.add((arm, key, "new", raised, t))
            elif t - published >= 10 * S:
                published = t
                out.add((arm, key, "sustained", raised, t))
            after = seen[i + 1][0] if i + 1 < len(seen) else None
            if after is None or after - t >= 4 * S or (gone is not None and gone < after):
                clear = min(t + 3 * S, gone) if gone is not None else t + 3 * S
                if clear <= last_us:
                    out.add((arm, key, "cleared", raised, clear))
    return out


@pytest.mark.parametrize("slice_s", [3.0, 7.0, 25.0, 3600.0])
def test_alert_lifecycle_in_slices(spark, slice_s):
    df, rows = detections(spark, 5)
    last = 600 * S
    got = alerts.lifecycle(df, last_tick_us=last, by=["arm"], slice_s=slice_s).select("arm", "alert_key", "state", "raised_us", "updated_us").collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == folded(rows, last)


def test_a_hot_key_is_many_slices(spark):
    rows = spark.range(20_000).select(F.lit(None).cast("double").alias("arm"), F.lit("k").alias("key"), F.col("id").alias("t"))
    cut = segments.sliced(rows, "t", 100.0)
    out = segments.filled(segments.neighbours(cut, ["arm", "key"], "t", ["t"], ["arm"]), ["arm", "key"], "t", "ten", F.when(F.col("t") % 1000 == 0, F.col("t")), ["arm"])
    out = segments.counted(out, ["arm", "key"], "t", "upto", F.col("t") % 3 == 0, ["arm"])
    wrong = ~(F.col("prev.t").eqNullSafe(F.when(F.col("t") > 0, F.col("t") - 1)) & F.col("next.t").eqNullSafe(F.when(F.col("t") < 19_999, F.col("t") + 1)))
    wrong = wrong | (F.col("ten") != F.floor(F.col("t") / 1000) * 1000) | (F.col("upto") != F.floor(F.col("t") / 3) + 1)
    assert out.count() == 20_000 and out.where(wrong).count() == 0
    assert out.groupBy(segments.SLICE).count().agg(F.max("count")).first()[0] == 100


@pytest.mark.parametrize("slice_s", [1.0, 20.0, 3600.0])
def test_truth_events_in_slices(spark, slice_s):
    rng = random.Random(3)
    rows = [("s", t, a, "z", 1.0 + t % 7, float(t % 11)) for a in "ab" for t in sorted(rng.sample(range(2000), 90))]
    df = spark.createDataFrame(rows, "scenario_id string, sec int, first_icao24 string, second_icao24 string, horizontal_nm double, vertical_ft double")
    want = []
    for a in "ab":
        spans = []
        for t in (r[1] for r in rows if r[2] == a):
            if spans and t - spans[-1][1] <= 30:
                spans[-1][1] = t
            else:
                spans.append([t, t])
        want += [(a, i + 1, *s) for i, s in enumerate(spans)]
    got = truth.conflict_events(df, slice_s=slice_s).select("first_icao24", "event_no", "started_s", "ended_s").collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("slice_s", [50.0, 3600.0])
def test_attribution_in_slices(spark, slice_s):
    rng = random.Random(9)
    m = [("s", rng.choice("ab"), float(rng.randint(0, 3000)), rng.choice(["turn", "climb"])) for _ in range(40)]
    a = [("s", rng.choice("ab"), rng.randint(0, 6000) / 2.0) for _ in range(150)]
    a = sorted(set(a))
    got = scoring.attribute(spark.createDataFrame(a, "scenario_id string, icao24 string, at_s double"), spark.createDataFrame(m, "scenario_id string, icao24 string, at_s double, kind string"), slice_s=slice_s)
    want = []
    for s, who, at in a:
        cause = min((x for x in m if x[1] == who and 0 <= at - x[2] <= 240.0), key=lambda x: (-x[2], x[3]), default=None)
        want.append((s, who, at, cause is not None, cause[2] if cause else None, cause[3] if cause else None))
    assert sorted(map(tuple, got.drop("lag_s").collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_events_of_copied_paths_are_those_of_every_pair(spark, seed):
    """Copies of a path, some of them seen later or shorter, have the events that second-by-second violations give."""
    rng, rows = random.Random(seed), []
    for path in range(12):
        lat, lon, alt = 40.0 + rng.random() * 0.2, -75.0 + rng.random() * 0.2, rng.choice([30000.0, 30500.0, 31500.0])
        for copy in range(5):
            start, end = (0, 200) if copy < 3 else (rng.randrange(40), rng.randrange(120, 200))
            hidden = (60, 60 + rng.choice([20, 45])) if copy == 4 else (0, 0)
            for sec in range(start, end, 3):
                if not hidden[0] <= sec < hidden[1]:
                    state = None if sec == 99 and path == 3 else alt
                    rows.append(("s", f"{path * 5 + copy:06x}", sec, lat + path * sec * 2e-5, lon + (path % 3) * sec * 3e-4, state))
    df = spark.createDataFrame(rows, "scenario_id string, icao24 string, sec int, lat double, lon double, altitude_ft double").cache()
    parts = truth.event_parts(df).cache()
    found = truth.violations(df).cache()
    want = {tuple(r) for r in truth.conflict_events(found).collect()}
    assert want and {tuple(r) for r in truth.joined_parts(parts, slice_s=50.0).collect()} == want
    # One row a pair and block of 31 s, and copies that are equal in a block are compared as one.
    assert parts.count() == found.select("first_icao24", "second_icao24", F.floor(F.col("sec") / 31)).distinct().count()
    assert truth.copies(df, 31).where("block = 3").agg(F.countDistinct("copy_of")).first()[0] < df.where("sec between 93 and 123").agg(F.countDistinct("icao24")).first()[0]


def test_a_lifecycle_works_detections_out_once(spark):
    df, rows = detections(spark, 5, n=60)
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    alerts.lifecycle(df.mapInArrow(counted, DETECTION), last_tick_us=10**12, by=["arm"]).count()
    assert made.value == len(rows)

"""Pairs met in blocks: few are judged for nothing, and what is folded equals the scan (F2 to F25)."""

import numpy as np
import pyarrow as pa

from wakeline.functions import geo
from wakeline.operators import pair_blocks


def sky_of(n, seed=3, ticks=2):
    """A group of one block: dense, climbing, some slow and some without a rate."""
    rng = np.random.default_rng(seed)
    rows = {"id": [f"trk-{i:06x}" for i in range(n)], "low": [0] * n, "high": [0] * n, "block": [0] * n, "tick_us": [[k * 1_000_000 for k in range(ticks)]] * n}
    state = [rng.uniform(-60, 60, n), rng.uniform(-60, 60, n), rng.uniform(-400, 400, n), rng.uniform(-400, 400, n), rng.uniform(30000, 36000, n), rng.choice([0.0, 1500.0, -6500.0], n)]
    state[2][: n // 4], state[3][: n // 4] = 1e-4, rng.choice([0.0, 1e-5, 0.3], n // 4)
    state[5][n // 2] = np.nan
    for name, x in zip(pair_blocks._STATE, state):
        rows[name] = [[float(v)] * ticks for v in x]
    return pair_blocks._Sky(pa.table(rows))


def test_pairs_that_may_conflict_are_hardly_more_than_those_that_do():
    sky = sky_of(400)
    for spans in ([300.0], [60.0, 300.0]):
        found = {(k, tick, i, j) for tick, k, a, b, *_ in sky.conflicts(spans, 5.0, 1000.0) for i, j in zip(a.tolist(), b.tolist())}
        looked = sum(len(i) for _, i, _ in sky.near([300.0], 5.0, 1000.0))
        s, wanted = sky.state, set()
        for tick, rows, _ in sky.instants():
            d = s[rows][None] - s[rows][:, None]
            rve, rvn, rvz = d[..., 2] / 3600, d[..., 3] / 3600, d[..., 5] / 60
            speed2 = rve**2 + rvn**2
            raw = np.where(speed2 >= 1e-12, -(d[..., 0] * rve + d[..., 1] * rvn) / np.where(speed2 >= 1e-12, speed2, 1.0), 0.0)
            for k, span in enumerate(spans):
                t = np.clip(raw, 0, span)
                hit = (np.hypot(d[..., 0] + rve * t, d[..., 1] + rvn * t) < 5.0) & (np.abs(d[..., 4] + rvz * t) < 1000.0)
                wanted |= {(k, tick, int(rows[i]), int(rows[j])) for i, j in zip(*np.nonzero(np.triu(hit, 1)))}
        assert found == wanted and len(wanted) > 300
        whole = sum(k == len(spans) - 1 for k, *_ in found)
        assert whole <= looked < 1.2 * whole


def test_approach_is_sent_to_tasks_after_the_module_was_used(spark):
    """A function of the session in the module of geometry cannot be sent: tasks must not get the module."""
    pairs = spark.createDataFrame([("s", "a", "b")], "scenario_id string, first_icao24 string, second_icao24 string")
    rows = spark.createDataFrame([("s", i, k, 40.0 + 0.01 * k, -75.0, 30000.0) for k, i in enumerate("ab")], "scenario_id string, icao24 string, sec int, lat double, lon double, altitude_ft double")
    rows = rows.withColumn("sec", rows.sec * 0)
    geo.held = spark.sparkContext
    try:
        assert pair_blocks.closest(rows, pairs, 5.0, 1000.0).count() == 1
    finally:
        del geo.held


def flown(spark, n=24, seconds=75):
    """A dense sky of tracks that come, go and leave gaps of all lengths around the limits."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        east, north, ve, vn = rng.uniform(-5, 5), rng.uniform(-5, 5), rng.uniform(-200, 200), rng.uniform(-200, 200)
        z, away, k = rng.uniform(30000, 31500), 0, 0
        for k in range(int(rng.integers(0, 30)), int(rng.integers(45, seconds))):
            away = away - 1 if away else int(rng.choice([0] * 40 + [1, 2, 3, 4, 6]))
            if not away:
                gone = int(rng.choice([0] * 30 + [1, 2]))
                turn = rng.choice([1.0] * 30 + [-1.0])
                rows.append(("s", k * 1_000_000, f"trk-{i:06x}", f"AC{i}" if i % 3 else None, float(east + ve * k / 3600), float(north + vn * k / 3600), float(ve * turn), float(vn), float(z + 100 * np.sin(k)), 1500.0 * (i % 4 == 0), (k + gone) * 1_000_000 if gone else None))
    return spark.createDataFrame(rows, "scenario_id string, tick_us long, track_id string, callsign string, east_nm double, north_nm double, v_east_kt double,"
                                 " v_north_kt double, altitude_ft double, vertical_rate_fpm double, vanish_tick_us long")


def scanned(monkeypatch, framed, **kwargs):
    """Conflicts of rows that are framed already, by the join."""
    from pyspark.sql import functions as F

    from wakeline.operators import conflicts

    monkeypatch.setattr(conflicts, "in_shared_frame", lambda x: x)
    return conflicts.predicted_conflicts(framed.withColumn("update_count", F.lit(9)), lookahead_s=[60.0, 300.0], **kwargs)


def test_alerts_followed_in_blocks_are_the_lifecycle_of_the_scan(spark, monkeypatch):
    """Blocks of five tracks, slices shorter and longer than a gap: the same publications, spells and running alerts."""
    from pyspark.sql import functions as F

    from wakeline.functions import labels
    from wakeline.operators import alerts, views

    framed = flown(spark).cache()
    found = scanned(monkeypatch, framed).where("lookahead_s = 300").cache()
    life = alerts.conflict_lifecycle(found, last_tick_us=60_000_000).cache()
    shown = ["alert_id", "alert_key", "severity", "state", "raised_us", "updated_us", "summary", "by_vanish", F.concat_ws(",", "track_ids"), F.concat_ws(",", "reason_codes"), F.round("conflict.min_horizontal_sep_nm", 9)]
    wanted = sorted(life.select(*shown).collect())
    states = {r.state for r in wanted}
    assert len(wanted) > 300 and states == {"new", "sustained", "cleared"} and any(r.by_vanish for r in wanted)
    islands = alerts.with_islands(found.select("scenario_id", labels.pair_key("first_track_id", "second_track_id").alias("alert_key"), "tick_us", "vanish_tick_us"))
    islands = sorted(islands.groupBy("alert_key", "raised_us").agg(F.count("*"), F.max("tick_us"), F.max("clear_us")).collect())
    for slice_s in (2, 13):
        blocks = pair_blocks.alert_spells(framed, 300.0, 5.0, 1000.0, **alerts.SCAN, size=5, slice_s=slice_s).withColumn("lookahead_s", F.lit(300.0)).cache()
        assert sorted(alerts.of_spells(blocks, 60_000_000).select(*shown).collect()) == wanted
        spells = blocks.where("state = 'cleared'").select(labels.pair_key("first_track_id", "second_track_id"), "raised_us", "detections", "tick_us", "updated_us")
        assert sorted(spells.collect()) == islands
        for at in (41_000_000, 70_000_000):
            now = min(at, 60_000_000)
            last = pair_blocks.alert_spells(framed.where(F.col("tick_us") <= now), 300.0, 5.0, 1000.0, **alerts.SCAN, running_at_us=now, size=5, slice_s=slice_s)
            got = alerts.of_spells(last.withColumn("lookahead_s", F.lit(300.0)), 60_000_000).select(*shown)
            # What lies between the end of the data and the instant was never scanned.
            cut = alerts.conflict_lifecycle(found.where("tick_us <= 60000000"), last_tick_us=60_000_000)
            assert sorted(got.collect()) == sorted(views.active_alerts(cut, at).select(*shown).collect()) and (got.count() > 3)


def test_conflicts_streamed_out_of_blocks_are_those_of_the_scan(spark, monkeypatch):
    from pyspark.sql import functions as F

    framed = flown(spark).cache()
    found = scanned(monkeypatch, framed)
    numbers = ["time_to_cpa_s", "min_horizontal_nm", "min_vertical_ft", "current_horizontal_nm", "current_vertical_ft"]
    shown = ["lookahead_s", "tick_us", "first_track_id", "second_track_id", "first_callsign", "second_callsign", "vanish_tick_us", *[F.round(c, 9) for c in numbers]]

    def rows(df):
        return sorted(df.select(*shown).collect(), key=str)

    wanted = rows(found)
    assert rows(pair_blocks.all_conflicts(framed, [60.0, 300.0], 5.0, 1000.0, size=5, slice_s=13)) == wanted and len(wanted) > 1000
    longest = {r[1:4]: r for r in sorted(wanted, key=lambda r: r[0])}
    assert rows(pair_blocks.all_conflicts(framed, [60.0, 300.0], 5.0, 1000.0, longest_only=True, size=5, slice_s=13)) == sorted(longest.values(), key=str)
    assert {r[0] for r in longest.values()} == {60.0, 300.0}

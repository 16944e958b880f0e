"""Alerts running at an instant, without the stream of all alerts (F19)."""

import functools

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators import alerts, conflicts, views
from wakeline.plans import live
from wakeline.plans.registered import EPOCH, QUERIES, load_all
from wakeline.sources import traffic

US = 1_000_000
load_all()


@pytest.mark.parametrize("last", [12, 60])
def test_running_alerts_are_those_raised_and_not_cleared(spark, last):
    """Gaps on both sides of the limit, a vanishing, one that is followed at once, and data that end before the instant."""
    seen = {"a": [1, 2, 5, 9, 10], "b": [3], "c": [4, 8, 12], "d": [6, 7, 8], "e": [2, 3, 4, 5]}
    vanish = {("a", 10): 11, ("d", 7): 8, ("e", 5): 6, ("c", 8): 9}
    rows = [("s", k, t * US, vanish.get((k, t), 0) * US or None, "x", "caution", "x", ["r"], [f"trk-{k}"]) for k, ticks in seen.items() for t in ticks]
    found = spark.createDataFrame(
        rows, "scenario_id string, alert_key string, tick_us long, vanish_tick_us long, kind string, severity string, summary string,"
        " reason_codes array<string>, track_ids array<string>").cache()
    life = alerts.lifecycle(found, last_tick_us=last * US).cache()
    both = []
    for at in range(2, 18, 3):
        both.append(views.active_alerts(life, at * US).select(F.lit("stream").alias("by"), F.lit(at).alias("at"), "alert_key"))
        both.append(alerts.running_at(found, at * US, last_tick_us=last * US).select(F.lit("last"), F.lit(at), "alert_key"))
    rows = functools.reduce(DataFrame.unionAll, both).collect()
    got, wanted = (sorted((r.at, r.alert_key) for r in rows if r.by == by) for by in ("last", "stream"))
    assert got == wanted and len(got) > 4


@pytest.mark.parametrize("at", [97, 520, 700])
def test_alerted_tracks_equal_the_flag_of_the_alert_stream(spark, sf, at):
    until = traffic.end_of_data(spark, sf)
    as_of = EPOCH + at * US
    s = live.sky(traffic.reports(spark, sf), until_us=until)
    whole = alerts.flag_alerted(views.live_tracks(s.updates, as_of), views.active_alerts(live.alert_stream(s), as_of))
    got = live.alerted_tracks(traffic.reports(spark, sf), as_of, until_us=until)
    assert sorted(got.select("scenario_id", "track_id", "alerted").collect()) == sorted(whole.select("scenario_id", "track_id", "alerted").collect())


def test_alerted_tracks_make_no_row_for_a_pair(spark, sf, monkeypatch):
    def scanned(*args, **kwargs):
        raise AssertionError("pairs became rows")

    monkeypatch.setattr(conflicts, "predicted_conflicts", scanned)
    assert QUERIES["d15_alerted_tracks"](spark, sf).where("alerted").count() > 0


def test_tracks_in_conflict_in_blocks_are_those_of_the_scan(spark, sf):
    from wakeline.operators import pair_blocks, picture

    p = live.sky(traffic.reports(spark, "/root/testdata/sf0.01"), until_us=EPOCH + 100 * US, within=(EPOCH + 90 * US, EPOCH + 100 * US)).picture
    assert p.agg(F.min("tick_us"), F.max("tick_us")).first()[:] == (EPOCH + 90 * US, EPOCH + 100 * US)
    scan = conflicts.predicted_conflicts(p)
    wanted = scan.select("scenario_id", F.explode(F.array("first_track_id", "second_track_id"))).distinct()
    got = pair_blocks.in_conflict(picture.in_shared_frame(picture.eligible(p)), 300.0, 5.0, 1000.0, size=9, slice_s=4).distinct()
    assert sorted(got.collect()) == sorted(wanted.collect()) and wanted.count() > 20

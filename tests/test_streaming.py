"""Streaming operators give the batch answer, across restarts and duplicates."""

import os
import tempfile
import time

from pyspark.sql import functions as F

from wakeline.operators import alerts, conflicts, conformance, tracking
from wakeline.plans import live
from wakeline.sources import traffic
from wakeline.streaming import checks
from wakeline.streaming.alerts import lifecycle_stream
from wakeline.streaming.scan import scan_step, with_wall_clock
from wakeline.streaming.tracking import track_updates_stream


def _files(df, time, parts, cuts):
    """Write `df` as one parquet folder per time span, in time order."""
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    edges = [0, *cuts, 10**18]
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        df.where((F.col(time) >= lo) & (F.col(time) < hi)).coalesce(1).write.mode("append").parquet(f"{root}/in")
    return f"{root}/in", root


def _run(stream, out, chk):
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", chk).trigger(availableNow=True).start()
    q.awaitTermination()


CUTS = [traffic.EPOCH_US + s * 1_000_000 for s in (60, 130, 200)]


def test_tracking_stream_equals_batch_with_restart_and_duplicates(spark, sf):
    reports = traffic.reports(spark, sf).where("scenario_id = 'sector-0'")
    path, root = _files(reports, "t_us", 4, CUTS)
    src = spark.readStream.schema(reports.schema).option("maxFilesPerTrigger", 1).parquet(path)
    _run(track_updates_stream(src), f"{root}/out", f"{root}/chk")
    # The same files again under new names, after a restart: all late or duplicate.
    spark.read.schema(reports.schema).parquet(path).where(F.col("t_us") > CUTS[2]).coalesce(1).write.mode("append").parquet(path)
    _run(track_updates_stream(src), f"{root}/out", f"{root}/chk")
    got = spark.read.parquet(f"{root}/out")
    want = tracking.track_updates(reports, as_of_us=traffic.end_of_data(spark, sf))
    num = ["lat", "lon", "altitude_ft", "ground_speed_kt", "turn_rate_deg_s", "position_uncertainty_m"]
    cols = ["icao24", "t_us", "state", "update_count", "callsign", "squawk", *[F.round(c, 6).alias(c) for c in num]]
    g, w = got.select(*cols), want.select(*cols)
    seen = g.where("state in ('initiating', 'confirmed')")
    assert seen.exceptAll(w).count() == 0
    assert w.where("state in ('initiating', 'confirmed')").exceptAll(seen).count() == 0
    # Silence that ended inside the data is announced exactly once, as in batch.
    inner = w.where((F.col("state") == "coasting") & (F.col("t_us") < CUTS[2])).select("icao24", "t_us")
    told = g.where((F.col("state") == "coasting") & (F.col("t_us") < CUTS[2])).select("icao24", "t_us")
    assert inner.exceptAll(told).count() == 0 and told.exceptAll(inner).count() == 0


def test_alert_stream_equals_batch(spark, sf):
    s = live.sky(traffic.reports(spark, sf), until_us=traffic.end_of_data(spark, sf))
    d = live.detections(s).select("scenario_id", "alert_key", "tick_us", "vanish_tick_us", "kind", "severity", "summary", "reason_codes", "track_ids")
    path, root = _files(d, "tick_us", 4, CUTS)
    src = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(path)
    _run(lifecycle_stream(src), f"{root}/out", f"{root}/chk")
    got = spark.read.parquet(f"{root}/out").select("alert_key", "state", "raised_us", "updated_us")
    want = alerts.lifecycle(d, last_tick_us=traffic.end_of_data(spark, sf)).select("alert_key", "state", "raised_us", "updated_us")
    assert want.count() > 20
    assert got.exceptAll(want).count() == 0
    # The stream may still owe clears that its watermark has not reached.
    owed = want.exceptAll(got)
    assert owed.where("state <> 'cleared'").count() == 0
    assert owed.where(F.col("updated_us") < traffic.EPOCH_US + 240_000_000).count() == 0


def test_scan_step_equals_batch_and_replays_cleanly(spark):
    sf = "/root/testdata/sf0.01"  # enough aircraft a sector to meet
    u = tracking.track_updates(traffic.reports(spark, sf), as_of_us=traffic.end_of_data(spark, sf))
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")

    def detect(p):
        return conflicts.predicted_conflicts(p).select("scenario_id", "tick_us", "first_track_id", "second_track_id")

    step = scan_step(detect, folder)
    edges = [0, *CUTS, 10**18]
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        part = u.where((F.col("t_us") >= lo) & (F.col("t_us") < hi))
        step(part, i)
        if i == 1:
            step(part, i)  # a replayed batch
    got = spark.read.parquet(f"{folder}/detections").drop("batch_id")
    # Batches that have left the look-back are not opened any more.
    assert len(spark.read.parquet(f"{folder}/frontier/batch_id={len(edges) - 2}").first()["live"]) < len(edges) - 1
    assert len(os.listdir(f"{folder}/frontier")) == 2
    last = spark.read.parquet(f"{folder}/frontier").agg(F.max("scanned_us")).first()[0]
    from wakeline.operators import picture

    want = detect(picture.at_ticks(u, until_us=last))
    assert want.count() > 50
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_streamed_checks_equal_batch_with_restart_and_duplicates(spark, sf):
    u = tracking.track_updates(traffic.reports(spark, sf), as_of_us=traffic.end_of_data(spark, sf))
    path, root = _files(u, "t_us", 4, CUTS[:2])
    read = lambda: spark.readStream.schema(u.schema).option("maxFilesPerTrigger", 1).parquet(path)
    _run(checks.matured_stream(read()), f"{root}/out", f"{root}/chk")
    u.where(F.col("t_us") >= CUTS[1]).coalesce(1).write.mode("append").parquet(path)  # delivered again
    _run(checks.matured_stream(read()), f"{root}/out", f"{root}/chk")
    cols = ["scenario_id", "track_id", "predicted_us", "matched_us", "source", *[F.round(c, 6).alias(c) for c in ("error_nm", "baseline_error_nm")]]
    got, want = spark.read.parquet(f"{root}/out").select(*cols), conformance.matured(conformance.predictions(u)).select(*cols)
    assert want.count() > 100
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_pending_predictions_resolve_once_or_are_dropped():
    s = 1_000_000

    def run(times, *, at_once=False):
        pending, last, done = [], None, []
        for part in [times] if at_once else [[t] for t in times]:
            pending, last, found = checks.resolve(pending, last, [((t * s, 0.0), ()) for t in part], 57 * s, 63 * s)
            done += [(d[0] // s, d[-1] // s) for d in found]
        return done, [p[0] // s for p in pending]

    steady = list(range(0, 130, 5))
    done, left = run(steady)
    assert done == [(t, t + 60) for t in range(0, 70, 5)] and left == list(range(70, 130, 5)) and run(steady, at_once=True) == (done, left)
    # One update resolves several; the first in time counts; a late one resolves none.
    assert run([0, 2, 4, 14, 24, 34, 44, 54, 61])[0] == [(0, 61), (2, 61), (4, 61)]
    assert run([0, 10, 20, 30, 40, 50, 64, 75]) == ([], [20, 30, 40, 50, 64, 75])
    assert run([0, 5, 5, 4, 15, 30, 45, 60])[0] == [(0, 60)]
    # Gone from the picture in between: nothing survives, not even at the right distance.
    assert run([0, 10, 27, 44, 61])[0] == []


def test_the_stored_picture_does_not_grow(spark):
    """One update a batch, ten seconds apart: only batches within the look-back stay."""
    folder, step = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), None
    row = tracking.track_updates(traffic.reports(spark, "/root/testdata/sf0.001"), as_of_us=traffic.EPOCH_US).limit(1)
    row = spark.createDataFrame(row.collect(), row.schema)
    step = scan_step(lambda p: p.select("scenario_id", "tick_us", "track_id"), folder)
    sizes = []
    for i in range(10):
        step(row.withColumn("t_us", F.lit(traffic.EPOCH_US + i * 10_000_000)), i)
        sizes.append(len(os.listdir(f"{folder}/updates")))
    assert max(sizes) == sizes[-1] <= 4 and len(os.listdir(f"{folder}/frontier")) == 2


def test_an_idle_source_still_moves_the_scan_clock(spark):
    """A real wall clock: updates stamped now, then silence; all ticks close until the track has vanished."""
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    row = tracking.track_updates(traffic.reports(spark, "/root/testdata/sf0.001"), as_of_us=traffic.EPOCH_US).limit(1)
    now = int(time.time()) * 1_000_000
    spark.createDataFrame(row.collect(), row.schema).withColumn("t_us", F.lit(now)).write.parquet(f"{root}/in")
    source = with_wall_clock(spark.readStream.schema(row.schema).parquet(f"{root}/in"))
    step = scan_step(lambda p: p.select("tick_us", "t_us"), f"{root}/scan")
    q = source.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/chk").trigger(processingTime="1 second").start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline and (not os.path.exists(f"{root}/scan/frontier") or _scanned(spark, root) < now + 20_000_000):
            time.sleep(1)
    finally:
        q.stop()
    got = sorted(r.tick_us for r in spark.read.parquet(f"{root}/scan/detections").collect())
    assert got == [now + s * 1_000_000 for s in range(16)]
    assert len(os.listdir(f"{root}/scan/updates")) <= 2


def _scanned(spark, root):
    newest = max((int(d.split("=")[1]) for d in os.listdir(f"{root}/scan/frontier") if os.path.exists(f"{root}/scan/frontier/{d}/_SUCCESS")), default=None)
    return 0 if newest is None else spark.read.parquet(f"{root}/scan/frontier/batch_id={newest}").first()["scanned_us"]

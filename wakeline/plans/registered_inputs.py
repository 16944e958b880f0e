"""Registered queries over records, scalar functions, read models and telemetry."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.functions import probability as pr
from wakeline.operators import conflicts, conformance, features, picture, telemetry, views
from wakeline.plans import live
from wakeline.plans.registered import AS_OF, EPOCH, query, rnd, scenario_table, sky, updates
from wakeline.session import cut_lineage, shared_folder
from wakeline.sources import contracts, scenarios, streams, traffic
from wakeline.streaming import checks, scan

REF_LAT, REF_LON = 40.6, -100.0

# -- scalar expressions -----------------------------------------------------


def _reports(spark, sf, *cols):
    return traffic.reports(spark, sf).select("report_id", *cols)


@query("b01_units")
def b01(spark, sf):
    return rnd(_reports(spark, sf, geo.knots_to_nm_per_second("ground_speed_kt").alias("nm_s"), geo.fpm_to_ft_per_second("vertical_rate_fpm").alias("ft_s")), 8, "nm_s", "ft_s")


@query("b02_normalize_bearing")
def b02(spark, sf):
    return rnd(_reports(spark, sf, geo.normalize_bearing(F.col("track_deg") - 540.5).alias("bearing")), 6, "bearing")


@query("b03_bearing_difference")
def b03(spark, sf):
    return rnd(_reports(spark, sf, geo.bearing_difference("track_deg", F.lit(90.0)).alias("turn")), 6, "turn")


@query("b04_haversine")
def b04(spark, sf):
    return rnd(_reports(spark, sf, geo.haversine_nm(REF_LAT, REF_LON, "lat", "lon").alias("nm")), 5, "nm")


@query("b05_initial_bearing")
def b05(spark, sf):
    return rnd(_reports(spark, sf, geo.initial_bearing(REF_LAT, REF_LON, "lat", "lon").alias("deg")), 6, "deg")


@query("b06_destination_point")
def b06(spark, sf):
    d = _reports(spark, sf, geo.destination_point("lat", "lon", "track_deg", 37.5).alias("p"))
    return rnd(d.select("report_id", "p.lat", "p.lon"), 7, "lat", "lon")


@query("b07_to_local_enu")
def b07(spark, sf):
    o = geo.snapped_origin("lat", "lon")
    d = _reports(spark, sf, geo.to_local_enu(o["lat"], o["lon"], "lat", "lon").alias("p"))
    return rnd(d.select("report_id", "p.east", "p.north"), 6, "east", "north")


@query("b08_from_local_enu")
def b08(spark, sf):
    d = _reports(spark, sf, geo.from_local_enu(REF_LAT, REF_LON, F.col("lat") * 2.0, F.col("lon") * 0.5).alias("p"))
    return rnd(d.select("report_id", "p.lat", "p.lon"), 7, "lat", "lon")


@query("b09_project_forward")
def b09(spark, sf):
    d = _reports(spark, sf, geo.project_forward("lat", "lon", "track_deg", "ground_speed_kt", 60.0).alias("p"))
    return rnd(d.select("report_id", "p.lat", "p.lon"), 7, "lat", "lon")


@query("b10_dead_reckoned_altitude")
def b10(spark, sf):
    return rnd(_reports(spark, sf, geo.dead_reckoned_altitude("altitude_baro_ft", "vertical_rate_fpm", 60.0).alias("ft"), F.col("altitude_baro_ft").alias("persistence_ft")), 4, "ft")


@query("b11_constant_turn")
def b11(spark, sf):
    t = updates(spark, sf, lifecycle=False)
    d = t.select("scenario_id", "icao24", "t_us", geo.constant_turn_of("lat", "lon", "track_deg", "ground_speed_kt", "turn_rate_deg_s", F.lit(60.0)).alias("p"))
    return rnd(d.select("scenario_id", "icao24", "t_us", "p.lat", "p.lon"), 6, "lat", "lon")


@query("b12_physics_residuals")
def b12(spark, sf):
    t = updates(spark, sf, lifecycle=False)
    d = t.select(
        "scenario_id", "icao24", "t_us", geo.constant_turn_residual("ground_speed_kt", "turn_rate_deg_s", 60.0).alias("c"),
        geo.persistence_residual("ground_speed_kt", "vertical_rate_fpm", 60.0).alias("p"),
    ).select("scenario_id", "icao24", "t_us", F.col("c.along").alias("turn_along"), F.col("c.cross").alias("turn_cross"),
             F.col("p.along").alias("stay_along"), F.col("p.alt").alias("stay_alt"))
    return rnd(d, 5, "turn_along", "turn_cross", "stay_along", "stay_alt")


@query("b13_along_cross")
def b13(spark, sf):
    lat2, lon2 = F.col("lat") + 0.05, F.col("lon") + 0.05
    d = _reports(spark, sf, "lat", "lon", "track_deg", geo.along_cross_error("lat", "lon", lat2, lon2, "track_deg").alias("e"))
    d = d.withColumn("back", geo.apply_along_cross("lat", "lon", "e.along", "e.cross", "track_deg"))
    d = d.select("report_id", "e.along", "e.cross", F.col("back.lat").alias("lat"), F.col("back.lon").alias("lon"))
    return rnd(rnd(d, 5, "along", "cross"), 6, "lat", "lon")


@query("b14_snapped_origin")
def b14(spark, sf):
    return _reports(spark, sf, geo.snapped_origin("lat", "lon").alias("o")).select("report_id", "o.lat", "o.lon")


@query("b15_track_id")
def b15(spark, sf):
    return _reports(spark, sf, geo.track_id("icao24").alias("track_id"))


@query("b16_projected_sigma")
def b16(spark, sf):
    t = updates(spark, sf, lifecycle=False)
    s = pr.projected_sigma("altitude_uncertainty_ft", 25.0, F.col("vertical_rate_uncertainty_fpm") / 60.0, 1.0, 120.0)
    return rnd(t.select("scenario_id", "icao24", "t_us", s.alias("sigma_ft")), 4, "sigma_ft")


_P = ["scenario_id", "icao24", "t_us"]


def _probability_inputs(spark, sf):
    t = updates(spark, sf, lifecycle=False)
    return t.select(*_P, (F.col("ground_speed_kt") / 100.0).alias("miss"), (F.col("position_uncertainty_m") / 100.0).alias("sigma"),
                    (F.col("altitude_ft") - 31000.0).alias("offset"), (F.col("altitude_uncertainty_ft") * 20.0).alias("sigma_ft"))


@query("b17_band_probability")
def b17(spark, sf):
    d = _probability_inputs(spark, sf)
    return rnd(d.select(*_P, pr.band_probability("offset", F.lit(1000.0), "sigma_ft").alias("p")), 6, "p")


@query("b18_disc_probability")
def b18(spark, sf):
    d = _probability_inputs(spark, sf)
    return rnd(d.select(*_P, pr.disc_probability("miss", F.lit(5.0), "sigma").alias("p")), 6, "p")


@query("b19_conflict_probability")
def b19(spark, sf):
    d = _probability_inputs(spark, sf)
    p = pr.conflict_probability("miss", "offset", "sigma", "sigma_ft", F.lit(5.0), F.lit(1000.0))
    return rnd(d.select(*_P, p.alias("p")), 6, "p")


@query("b20_flight_phase")
def b20(spark, sf):
    return traffic.truth(spark, sf).select("scenario_id", "icao24", "sec", "phase")


# -- records ----------------------------------------------------------------


@query("a01_json_reports")
def a01(spark, sf):
    parsed = contracts.parse(streams.to_messages(traffic.report_records(spark, sf), "icao24"), contracts.REPORTS)
    r = contracts.valid(parsed, contracts.REPORTS)
    return r.select("report_id", "icao24", "callsign", F.unix_micros("observed_at").alias("t_us"), "lat", "lon", "altitude_baro_ft",
                    "ground_speed_kt", "track_deg", "squawk", "on_ground", "scenario_id")


@query("a02_dead_letters")
def a02(spark, sf):
    parsed = contracts.parse(traffic.messages(spark, sf), contracts.REPORTS)
    reason = F.when(F.size("reasons") == 0, "valid").otherwise(F.concat_ws(",", "reasons"))
    return parsed.groupBy(reason.alias("outcome")).agg(F.count("*").alias("n"))


@query("a02_track_dead_letters")
def a02_tracks(spark, sf):
    """Track records, some with a value out of its range, by what the contract says of them."""
    n = F.pmod("update_count", F.lit(10))
    t = updates(spark, sf, lifecycle=False).withColumns({
        "innovation_nm": F.when(n == 1, -1.0).otherwise(F.col("innovation_nm")),
        "velocity_uncertainty_kt": F.when(n == 2, -0.5).otherwise(F.col("velocity_uncertainty_kt")),
        "altitude_uncertainty_ft": F.when(n == 3, -0.5).otherwise(F.col("altitude_uncertainty_ft")),
        "state": F.when(n == 5, "lost").otherwise(F.col("state")),
        "update_count": F.when(n == 4, 0).when(n == 6, -1).otherwise(F.col("update_count")).cast("int"),
        "updated_at": F.timestamp_micros("t_us"), "last_report_at": F.timestamp_micros("last_report_us"), "source": F.lit("simulator"),
    })
    names = [f for f in contracts.TRACK_UPDATE.fieldNames() if f in t.columns]
    parsed = contracts.parse(streams.to_messages(t.select(*names), "icao24"), contracts.TRACKS)
    reason = F.when(F.size("reasons") == 0, "valid").otherwise(F.concat_ws(",", "reasons"))
    return parsed.groupBy(reason.alias("outcome")).agg(F.count("*").alias("n"))


@query("a03_keyed_messages")
def a03(spark, sf):
    r = traffic.reports(spark, sf).select("icao24", "report_id", "lat", "lon")
    return streams.to_messages(r, "icao24")


@query("a04_correlation_ids")
def a04(spark, sf):
    m = traffic.messages(spark, sf)
    c = streams.correlation_id(F.col("headers"), F.concat_ws("|", "topic", "partition", "offset"))
    return m.select("partition", "offset", c.alias("correlation_id"))


@query("a05_start_positions")
def a05(spark, sf):
    return streams.start_positions(traffic.messages(spark, sf)).select("partition", "earliest", "latest", "messages")


@query("a06_idempotent_points")
def a06(spark, sf):
    u = updates(spark, sf)
    stored = u.where(F.col("t_us") <= AS_OF)
    new = views.history_points(u.unionByName(u), stored)
    return rnd(new.select("scenario_id", "track_id", "t_us", "lat", "lon", "altitude_ft"), 6, "lat", "lon", "altitude_ft")


@query("a07_upserted_tracks")
def a07(spark, sf):
    u = updates(spark, sf)
    table = views.track_rows(u.where(F.col("t_us") <= AS_OF))
    return views.upsert_tracks(table, u.where(F.col("t_us") > AS_OF - 30_000_000))


def _live(spark, sf, window_s=20.0):
    return views.live_tracks(updates(spark, sf), AS_OF, window_s)


@query("a08_live_picture")
def a08(spark, sf):
    t = _live(spark, sf)
    return rnd(t.select("scenario_id", "track_id", "t_us", "state", "lat", "lon"), 6, "lat", "lon")


@query("a11_live_tracks_window")
def a11(spark, sf):
    t = views.by_label(_live(spark, sf, 60.0))
    return t.select("scenario_id", "track_id", "callsign", "t_us", "state")


@query("g04_tracks_by_label")
def g04(spark, sf):
    return views.by_label(_live(spark, sf, 10.0)).select("scenario_id", "track_id", F.coalesce("callsign", "icao24").alias("label"))


def _active(spark, sf, kinds=None):
    return live.active_alerts(sky(spark, sf), AS_OF, kinds)


@query("a09_active_alerts")
def a09(spark, sf):
    return _active(spark, sf).select("scenario_id", "alert_key", "kind", "severity", "state", "updated_us")


@query("a12_alerts_of_kind")
def a12(spark, sf):
    return _active(spark, sf, ["emergency_squawk", "non_conformance"]).select("scenario_id", "alert_key", "kind", "updated_us")


@query("g02_alerts_by_severity")
def g02(spark, sf):
    return views.by_severity(_active(spark, sf)).select("scenario_id", "alert_key", "severity", "updated_us")


@query("g03_alerts_newest_first")
def g03(spark, sf):
    return _active(spark, sf).select("scenario_id", "alert_key", "updated_us")


@query("d15_alerted_tracks")
def d15(spark, sf):
    t = live.alerted_tracks(traffic.reports(spark, sf), AS_OF, until_us=traffic.end_of_data(spark, sf))
    return t.select("scenario_id", "track_id", "alerted")


@query("a10_history_tail")
def a10(spark, sf):
    t = views.history_tail(updates(spark, sf).select("scenario_id", "track_id", "t_us", "altitude_ft"), 50)
    return rnd(t, 5, "altitude_ft")


@query("g05_top_points_per_track")
def g05(spark, sf):
    t = views.history_tail(updates(spark, sf).select("scenario_id", "track_id", "t_us", "state"), 3)
    return t


@query("f07_track_trails")
def f07(spark, sf):
    t = views.trails(updates(spark, sf))
    pts = F.transform("trail", lambda d: F.concat_ws("@", geo.round_scaled(d["lat"], 4).cast("string"), d["t_us"].cast("string")))
    return t.select("scenario_id", "track_id", F.size("trail").alias("points"), F.concat_ws(";", pts).alias("trail"))


@query("a13_snapshot_frames")
def a13(spark, sf):
    """Every part of every scenario's frame, at forty entries a part."""
    s = sky(spark, sf)
    # Counted and dealt: read twice.
    active = cut_lineage(live.active_alerts(s, AS_OF).select("scenario_id", "alert_key", "kind", "severity", "state", "summary"))
    f = views.snapshot_frames(views.live_tracks(s.updates, AS_OF), active, 40)
    return f.select(
        "scenario_id", "part",
        F.concat_ws(",", F.sort_array(F.transform("tracks", lambda t: t["label"]))).alias("tracks"),
        F.concat_ws(",", F.sort_array(F.transform("alerts", lambda a: a["alert_key"]))).alias("alerts"),
    )


@query("a02_alert_dead_letters")
def a02_alerts(spark, sf):
    """Alert messages of which some were damaged on the way, and what their contract says of each, nested evidence included."""
    a = live.alert_stream(sky(spark, sf))
    digit, c = F.substring("alert_id", 1, 1), F.col("conflict")
    damaged = c.withField("lookahead_s", F.when(digit == "0", F.lit(0.0)).otherwise(c["lookahead_s"]))
    damaged = damaged.withField("min_vertical_sep_ft", F.when(digit == "1", F.lit(-1.0)).when(digit == "2", F.lit(None)).otherwise(c["min_vertical_sep_ft"]))
    records = a.select(
        F.lit(contracts.CONTRACT_VERSION).alias("schema_version"), "alert_id", "alert_key", "kind",
        F.when(digit == "3", "fatal").otherwise(F.col("severity")).alias("severity"), "state",
        F.timestamp_micros("raised_us").alias("raised_at"), F.timestamp_micros("updated_us").alias("updated_at"), "track_ids", "reason_codes",
        F.when(digit != "4", F.col("summary")).alias("summary"), F.when(c.isNotNull(), damaged).alias("conflict"),
        F.when(F.col("conformance").isNotNull(), F.col("conformance").dropFields("predicted_us").withField("predicted_at", F.timestamp_micros("conformance.predicted_us"))).alias("conformance"),
        F.lit("simulator").alias("source"), "scenario_id",
    )
    parsed = contracts.parse(streams.to_messages(records.withColumn("of", F.col("kind")), "alert_key", ("of",)), contracts.ALERTS)
    return contracts.dead_letters(parsed).groupBy(F.col("of").alias("kind"), F.concat_ws(",", "reasons").alias("reasons")).agg(F.count("*").alias("n"))


@query("a14_flight_plans")
def a14(spark, sf):
    docs = traffic.scenario_documents(spark, sf).select(F.to_json(F.struct("*")).alias("j"))
    parsed = docs.select(F.from_json("j", scenarios.SCENARIO).alias("d")).select("d.*")
    return scenarios.flight_plans(parsed).orderBy("scenario_id", "icao24", "at_s")


@query("a15_scenario_violations")
def a15(spark, sf):
    specs = scenarios.aircraft(traffic.scenario_documents(spark, sf).withColumn("duration_s", F.lit(5.0)))
    return scenarios.violations(specs.withColumn("callsign", F.substring("callsign", 1, 7)))


@query("a16_fingerprint")
def a16(spark, sf):
    return scenarios.fingerprint(traffic.truth(spark, sf).select("scenario_id", "icao24", "sec", "lat", "lon", "altitude_ft", "phase"))


@query("h04_scenario_union")
def h04(spark, sf):
    s = scenario_table(spark, sf)
    curated = s.where("density > 0.3").withColumn("origin", F.lit("curated"))
    return s.where("family = 'nominal'").withColumn("origin", F.lit("generated")).unionByName(curated).select("scenario_id", "family", "origin")


@query("h05_schema_drift")
def h05(spark, sf):
    """Observed record fields of two producers compared as data contracts."""
    m = streams.to_messages(traffic.report_records(spark, sf, "event_type"), "icao24", ("event_type",))
    kinds = traffic.load(spark, sf, "events").select("event_type")
    fields = m.select("event_type", F.explode(F.json_object_keys("value")).alias("field"))
    per = fields.groupBy("event_type", "field").agg(F.count("*").alias("c"))
    n = kinds.groupBy("event_type").agg(F.count("*").alias("n"))
    listing = per.join(n, "event_type").select("event_type", F.lit("reports").alias("table"), "field", F.lit("observed").alias("type"), (F.col("c") == F.col("n")).alias("required"))
    return contracts.drift(listing.where("event_type = 'view'"), listing.where("event_type = 'signup'")).select("field", "change")


# -- filters ----------------------------------------------------------------


@query("c05_confirmed_only")
def c05(spark, sf):
    return updates(spark, sf, lifecycle=False).where("state = 'confirmed'").groupBy("scenario_id").agg(F.count("*").alias("n"))


@query("c07_clock_guard")
def c07(spark, sf):
    r = traffic.report_records(spark, sf)
    wall = F.timestamp_micros(F.lit(EPOCH - 86_400_000_000 + 130_000_000))
    ahead = contracts.ahead_of_clock(r, "observed_at", wall)
    return r.groupBy("scenario_id").agg(F.count_if(~ahead).alias("on_time"), F.count_if(ahead).alias("ahead"))


@query("c08_feature_sanity")
def c08(spark, sf):
    return features.non_finite_counts(features.complete(features.with_features(updates(spark, sf, lifecycle=False))))


# -- telemetry --------------------------------------------------------------


@query("e16_counters")
def e16(spark, sf):
    a = live.alert_stream(sky(spark, sf))
    return telemetry.counters(a, "updated_us", "kind", "state")


@query("e16_live_tracks")
def e16_live(spark, sf):
    """Tracks in the picture at each full minute."""
    end = traffic.end_of_data(spark, sf)
    v = picture.validity(updates(spark, sf)).withColumn("until_tick_us", F.least("until_tick_us", F.lit(end))).where("from_tick_us <= until_tick_us")
    return telemetry.gauge(v.withColumn("end_us", F.col("until_tick_us") + 1_000_000), "from_tick_us", "end_us", "scenario_id")


@query("e16_active_alerts")
def e16_active(spark, sf):
    """Alerts raised and not yet cleared at each full minute, by kind."""
    a = live.alert_stream(sky(spark, sf), states=("new", "cleared"))
    # Starts and ends are counted apart: an alert's two messages need not meet.
    spans = a.select("scenario_id", "kind", F.when(F.col("state") == "new", F.col("raised_us")).alias("start_us"), F.when(F.col("state") == "cleared", F.col("updated_us")).alias("end_us"))
    return telemetry.gauge(spans, "start_us", "end_us", "scenario_id", "kind")


@query("e16_message_counters")
def e16_messages(spark, sf):
    """Messages of each topic that were taken in or discarded, and why."""
    parsed = contracts.parse(traffic.messages(spark, sf), contracts.REPORTS)
    fate = F.when(F.size("reasons") == 0, "consumed").otherwise("discarded")
    return parsed.groupBy("topic", "partition", fate.alias("outcome")).agg(F.count("*").alias("n"))


@query("e20_alert_totals")
def e20_alerts(spark, sf):
    """Alert messages of the whole run, by kind and state."""
    return live.alert_stream(sky(spark, sf)).groupBy("kind", "state").agg(F.count("*").alias("n"))


@query("a17_published_results")
def a17(spark, sf):
    """Results of two runs in one place, one of them published twice."""
    counted = traffic.reports(spark, sf).groupBy("scenario_id").agg(F.count("*").alias("reports"))
    path = f"{shared_folder(spark)}/wakeline-results/{uuid.uuid4().hex}"
    for run in ("first", "second", "first"):
        streams.write_results(counted, path, run, stamps={"code_version": contracts.CONTRACT_VERSION})
    stored = spark.read.schema("scenario_id string, reports long, code_version string, run string").option("basePath", path)
    return stored.parquet(path).select("run", "scenario_id", "reports", "code_version")


@query("e17_rates_and_latency")
def e17(spark, sf):
    v = picture.validity(updates(spark, sf)).withColumn("latency_s", (F.col("from_tick_us") - F.col("t_us")) / 1e6)
    h = telemetry.histogram(v, "latency_s", "scenario_id")
    q = telemetry.histogram_quantiles(h, "scenario_id")
    return rnd(q, 6, "value")


@query("e17_report_rates")
def e17b(spark, sf):
    return rnd(telemetry.rates(traffic.reports(spark, sf), "t_us", "scenario_id"), 6, "per_second")


@query("e18_consumer_lag")
def e18(spark, sf):
    m = traffic.messages(spark, sf).select("topic", "partition", "offset")
    heads = m.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("head"))
    seen = traffic.events(spark, sf).where(F.col("t_us") <= AS_OF).select(
        F.lit("surveillance.reports.v1").alias("topic"), F.pmod("user_id", F.lit(6)).cast("int").alias("partition"), F.col("event_id").alias("offset"))
    return telemetry.consumer_lag(seen, heads).select("partition", "lag")


@query("e20_run_totals")
def e20(spark, sf):
    s = sky(spark, sf)
    return telemetry.totals(
        reports=traffic.reports(spark, sf), updates=s.updates, terminated=s.updates.where("state = 'terminated'"),
        scans=s.picture.select("scenario_id", "tick_us").distinct(), conflicts=conflicts.predicted_conflicts(s.picture),
    )


# -- clocks and queues ------------------------------------------------------


@query("j05_prunable_tracks")
def j05(spark, sf):
    u = cut_lineage(updates(spark, sf))
    # As of the last track to vanish for good, so that there is one to prune.
    gone = u.where("state = 'terminated'").agg(F.max("t_us").alias("t")).first()["t"]
    as_of = gone if gone is not None else traffic.end_of_data(spark, sf)
    return views.prunable(u, as_of, 20.0).select("scenario_id", "track_id", "last_report_us")


@query("j06_streamed_scan")
def j06(spark, sf):
    """Conflicts found by the scan on a stream of updates, as stored batch by batch over a restart."""
    folder = f"{shared_folder(spark)}/wakeline/scan-{uuid.uuid4().hex}"

    def detect(ticks):
        return conflicts.in_blocks(ticks).select("scenario_id", "tick_us", "first_track_id", "second_track_id")

    streamed(None, updates(spark, sf), "t_us", each=scan.scan_step(detect, folder))
    return spark.read.parquet(f"{folder}/detections").drop("batch_id")


@query("j07_scan_summary")
def j07(spark, sf):
    s = sky(spark, sf)
    c = conflicts.predicted_conflicts(s.picture).groupBy("scenario_id", "tick_us").agg(F.count("*").alias("conflicts"))
    t = s.picture.groupBy("scenario_id", "tick_us").agg(F.count("*").alias("tracks"))
    return t.join(c, ["scenario_id", "tick_us"], "left").fillna(0, ["conflicts"])


@query("j08_predict_and_check")
def j08(spark, sf):
    p = conformance.predictions(updates(spark, sf)).where("state <> 'terminated'")
    made = p.groupBy("scenario_id", "track_id").agg(F.count("*").alias("predictions"))
    m = conformance.matured(p).groupBy("scenario_id", "track_id").agg(F.count("*").alias("checked"))
    return made.join(m, ["scenario_id", "track_id"], "left").fillna(0, ["checked"])


def streamed(stream_of, table: DataFrame, time: str, parts: int = 4, each=None) -> DataFrame | None:
    """What a stream over `table`, delivered in `parts` in order of time, has written when all is read.

    Each part is read after a restart from the checkpoint. With `each`,
    every micro-batch is handed to that function instead.
    """
    spark = table.sparkSession
    folder = f"{shared_folder(spark)}/wakeline/stream-{uuid.uuid4().hex}"
    held = cut_lineage(table)
    edges = held.agg(F.percentile_approx(time, [k / parts for k in range(1, parts)], 1000)).first()[0] or []
    # State partitions are fixed at the first start and never coalesced: one for each core.
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism),
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    bounds = [None, *sorted(set(edges)), None]
    try:
        for lo, hi in zip(bounds, bounds[1:]):
            part = held.where((F.lit(lo is None) | (F.col(time) > F.lit(lo))) & (F.lit(hi is None) | (F.col(time) <= F.lit(hi))))
            # A part is written by all tasks, and read by all as one micro-batch: each start takes what is there.
            part.write.mode("append").parquet(f"{folder}/in")
            source = spark.readStream.schema(held.schema).parquet(f"{folder}/in")
            if each is not None:
                sink = source.writeStream.foreachBatch(each)
            else:
                sink = stream_of(source).writeStream.format("parquet").option("path", f"{folder}/out")
            sink.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)
    return spark.read.parquet(f"{folder}/out") if each is None else None


@query("j08_streamed_checks")
def j08_streamed(spark, sf):
    """The checks of d05 from a stream of track updates, over a restart."""
    m = streamed(checks.matured_stream, updates(spark, sf), "t_us")
    return rnd(m.select("scenario_id", "track_id", "predicted_us", "matched_us", "error_nm", "baseline_error_nm"), 4, "error_nm", "baseline_error_nm")


@query("j10_scan_clock")
def j10(spark, sf):
    p = picture.at_ticks(updates(spark, sf), until_us=traffic.end_of_data(spark, sf))
    return p.groupBy("tick_us").agg(F.max("t_us").alias("newest_us"), F.count("*").alias("tracks"))


@query("j10_idle_source")
def j10_idle(spark, sf):
    """Tracks at each scan of a stream whose source falls silent, while the wall clock beats on for half a minute."""
    folder = f"{shared_folder(spark)}/wakeline/scan-{uuid.uuid4().hex}"
    beats = spark.range(1, 31).select((F.lit(AS_OF) + F.col("id") * 1_000_000).alias("beat_us"))
    table = updates(spark, sf).where(F.col("t_us") <= AS_OF).unionByName(beats, allowMissingColumns=True)

    def detect(ticks):
        return ticks.groupBy("scenario_id", "tick_us").agg(F.count("*").alias("tracks"), F.max("t_us").alias("newest_us"))

    streamed(None, table.withColumn("at_us", F.coalesce("t_us", "beat_us")), "at_us", each=scan.scan_step(detect, folder))
    return spark.read.parquet(f"{folder}/detections").drop("batch_id")

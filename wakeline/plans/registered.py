"""Every registered query: name -> callable(spark, sf_dir) -> DataFrame.

Names start with the identifier of the operator they exercise. All of them
read the provided tables in full. Results of chained trigonometry are rounded,
because platforms disagree in the last bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions import geo, labels
from wakeline.functions import probability as pr
from wakeline.operators import (
    alerts, bootstrap, conflicts, conformance, features, picture, rules, scoring, telemetry, tracking, truth, views,
)
from wakeline.plans import evaluation, live, training
from wakeline.session import cut_lineage
from wakeline.sources import contracts, scenarios, streams, traffic

QUERIES: dict = {}
EPOCH = traffic.EPOCH_US
AS_OF = EPOCH + 200_000_000


def query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn

    return add


def rnd(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in cols})


# -- inputs -----------------------------------------------------------------


def sky(spark: SparkSession, sf: str) -> live.Sky:
    """Live view: reports plus silence-driven rows."""
    return live.sky(traffic.reports(spark, sf), until_us=traffic.end_of_data(spark, sf))


def replay(spark: SparkSession, sf: str) -> live.Sky:
    """Evaluation view: reports only."""
    return live.sky(traffic.reports(spark, sf), until_us=traffic.end_of_data(spark, sf), lifecycle=False)


def updates(spark: SparkSession, sf: str, lifecycle: bool = True) -> DataFrame:
    return tracking.track_updates(traffic.reports(spark, sf), as_of_us=traffic.end_of_data(spark, sf), lifecycle=lifecycle)


def scenario_table(spark: SparkSession, sf: str) -> DataFrame:
    """One row per scenario with its duration, family and manoeuvre density."""
    u = F.col("user_id")
    s = traffic.sector(u)
    acts = traffic.activity(spark, sf)
    turning = F.pmod(traffic.member(u), F.lit(3)) == 0
    return (
        acts.groupBy(traffic.identity(u)["scenario_id"].alias("scenario_id"), F.pmod(s, F.lit(2)).alias("parity"))
        .agg(F.round(F.count_if(turning) / F.count("*"), 2).alias("density"))
        .select(
            "scenario_id", F.lit((traffic.end_of_data(spark, sf) - EPOCH) / 1e6).alias("duration_s"),
            F.when(F.col("parity") == 0, "nominal").otherwise("shifted").alias("family"), "density",
        )
    )


def evaluation_inputs(spark: SparkSession, sf: str):
    return replay(spark, sf), traffic.truth(spark, sf), scenario_table(spark, sf)


# -- tracking ---------------------------------------------------------------

_STATE_COLS = ["lat", "lon", "altitude_ft", "ground_speed_kt", "track_deg", "vertical_rate_fpm", "turn_rate_deg_s", "innovation_nm"]
_SIGMA_COLS = ["position_uncertainty_m", "velocity_uncertainty_kt", "altitude_uncertainty_ft", "vertical_rate_uncertainty_fpm"]


@query("j01_track_estimates")
def j01(spark, sf):
    t = updates(spark, sf, lifecycle=False)
    return rnd(t.select("scenario_id", "icao24", "track_id", "t_us", "update_count", "state", "callsign", "squawk", *_STATE_COLS, *_SIGMA_COLS),
               6, *_STATE_COLS, *_SIGMA_COLS)


@query("j02_lifecycle_transitions")
def j02(spark, sf):
    t = updates(spark, sf).where(F.col("state").isin("coasting", "terminated"))
    return t.select("scenario_id", "icao24", "t_us", "last_report_us", "state", "update_count")


@query("j03_coasting_growth")
def j03(spark, sf):
    t = updates(spark, sf).where("state = 'coasting'")
    # Five digits before the point leave the fourth after it to the platform.
    t = rnd(t.select("scenario_id", "icao24", "t_us", "lat", "lon", "altitude_ft", *_SIGMA_COLS), 4, "lat", "lon", *_SIGMA_COLS)
    return rnd(t, 3, "altitude_ft")


@query("j04_late_reports_dropped")
def j04(spark, sf):
    """Every report delivered twice: nothing may change."""
    r = traffic.reports(spark, sf)
    t = tracking.track_updates(r.unionByName(r), as_of_us=traffic.end_of_data(spark, sf), lifecycle=False)
    return t.groupBy("scenario_id", "icao24").agg(
        F.count("*").alias("n"), F.max("update_count").alias("max_count"), F.round(F.sum("ground_speed_kt"), 3).alias("speed_sum")
    )


@query("f02_turn_rate")
def f02(spark, sf):
    t = updates(spark, sf, lifecycle=False)
    return rnd(t.select("scenario_id", "icao24", "t_us", "turn_rate_deg_s"), 5, "turn_rate_deg_s")


@query("f03_update_counts")
def f03(spark, sf):
    t = updates(spark, sf, lifecycle=False)
    return t.groupBy("scenario_id", "icao24", "segment_us").agg(
        F.max("update_count").alias("updates"), F.count_if(F.col("state") == "confirmed").alias("confirmed")
    )


@query("f04_flight_segments")
def f04(spark, sf):
    t = updates(spark, sf, lifecycle=False)
    return t.groupBy("scenario_id", "icao24", "segment_us").agg(F.count("*").alias("n"), F.max("t_us").alias("last_us"))


@query("c06_order_guard")
def c06(spark, sf):
    t = updates(spark, sf, lifecycle=False)
    return t.groupBy("scenario_id").agg(F.count("*").alias("kept"), F.countDistinct("icao24", "t_us").alias("instants"))


# -- picture and conflicts --------------------------------------------------


@query("d04_tick_picture")
def d04(spark, sf):
    p = picture.at_ticks(updates(spark, sf), until_us=traffic.end_of_data(spark, sf))
    return rnd(p.select("scenario_id", "track_id", "tick_us", "t_us", "state", "update_count", "lat", "lon", "vanish_tick_us"), 6, "lat", "lon")


@query("f09_validity_intervals")
def f09(spark, sf):
    v = picture.validity(updates(spark, sf))
    return v.select("scenario_id", "track_id", "t_us", "from_tick_us", "until_tick_us", "vanish_tick_us")


@query("c04_stale_expiry")
def c04(spark, sf):
    return picture.vanished(updates(spark, sf), until_us=traffic.end_of_data(spark, sf))


@query("h03_vanished_tracks")
def h03(spark, sf):
    """Tracks of one scan missing from the next, by anti join of consecutive pictures."""
    s = sky(spark, sf)
    p = s.picture.select("scenario_id", "track_id", "tick_us")
    later = p.select("scenario_id", "track_id", (F.col("tick_us") - 1_000_000).alias("tick_us"))
    return (
        p.where(F.col("tick_us") < traffic.end_of_data(spark, sf)).join(later, ["scenario_id", "track_id", "tick_us"], "left_anti")
        .select("scenario_id", "track_id", (F.col("tick_us") + 1_000_000).alias("tick_us"))
    )


@query("c01_eligible_tracks")
def c01(spark, sf):
    p = picture.at_ticks(updates(spark, sf), until_us=traffic.end_of_data(spark, sf))
    return picture.eligible(p).groupBy("scenario_id", "tick_us").agg(F.count("*").alias("n"), F.min("update_count").alias("least"))


@query("e01_frame_origins")
def e01(spark, sf):
    s = sky(spark, sf)
    o = picture.frame_origins(picture.eligible(s.picture))
    r = picture.radius(picture.eligible(s.picture))
    j = o.join(r.drop("tracks"), ["scenario_id", "tick_us"])
    return rnd(j, 5, "ref_lat", "ref_lon", "radius_nm")


_CONFLICT_NUM = ["time_to_cpa_s", "min_horizontal_nm", "min_vertical_ft", "current_horizontal_nm", "current_vertical_ft"]


@query("d01_conflict_pairs")
def d01(spark, sf):
    c = conflicts.in_blocks(sky(spark, sf).picture)
    return rnd(c.select("scenario_id", "tick_us", "first_track_id", "second_track_id", *_CONFLICT_NUM), 4, *_CONFLICT_NUM)


@query("d02_probable_conflicts")
def d02(spark, sf):
    c = conflicts.probable_conflicts(sky(spark, sf).picture, 0.35)
    return rnd(c.select("scenario_id", "tick_us", "first_track_id", "second_track_id", "probability"), 5, "probability")


@query("b21_conflict_labels")
def b21(spark, sf):
    d = alerts.from_conflicts(conflicts.in_blocks(sky(spark, sf).picture))
    return d.select("scenario_id", "tick_us", "alert_key", "severity", F.concat_ws(",", "reason_codes").alias("reason_codes"), "summary")


@query("g01_soonest_first")
def g01(spark, sf):
    c = conflicts.in_blocks(sky(spark, sf).picture)
    return rnd(c.select("scenario_id", "tick_us", "first_track_id", "second_track_id", "time_to_cpa_s").orderBy("time_to_cpa_s"), 4, "time_to_cpa_s")


@query("c02_emergency_squawks")
def c02(spark, sf):
    p = picture.at_ticks(updates(spark, sf), until_us=traffic.end_of_data(spark, sf))
    return rules.emergency_squawks(p).select("scenario_id", "tick_us", "track_id", "severity", "summary", F.concat_ws(",", "reason_codes").alias("reason_codes"))


@query("c03_excessive_descents")
def c03(spark, sf):
    p = picture.at_ticks(updates(spark, sf), until_us=traffic.end_of_data(spark, sf))
    return rules.excessive_descents(p).select("scenario_id", "tick_us", "track_id", "severity", "summary", F.concat_ws(",", "reason_codes").alias("reason_codes"))


# -- conformance ------------------------------------------------------------


@query("d05_matured_predictions")
def d05(spark, sf):
    m = conformance.matured(conformance.predictions(updates(spark, sf)))
    return rnd(m.select("scenario_id", "track_id", "predicted_us", "matched_us", "error_nm", "baseline_error_nm"), 4, "error_nm", "baseline_error_nm")


@query("k10_calibrated_thresholds")
def k10(spark, sf):
    m = conformance.matured(conformance.predictions(updates(spark, sf)))
    cal = spark.createDataFrame(
        [(s, h, e) for s, t in conformance.TYPICAL_ERROR_NM.items() for h, e in t.items()], "source string, horizon_s double, typical_nm double"
    )
    j = conformance.calibrated_thresholds(m, cal)
    return j.groupBy("source", "horizon_s", "threshold_nm").agg(F.count("*").alias("n"), F.count_if(F.col("error_nm") > F.col("threshold_nm")).alias("over"))


@query("e02_worst_deviation")
def e02(spark, sf):
    f = conformance.deviations(conformance.matured(conformance.predictions(updates(spark, sf))))
    return rnd(f.select("scenario_id", "track_id", "matched_us", "predicted_us", "error_nm", "threshold_nm"), 4, "error_nm", "threshold_nm")


@query("b22_deviation_labels")
def b22(spark, sf):
    s = sky(spark, sf)
    f = conformance.per_scan(conformance.deviations(conformance.matured(conformance.predictions(s.updates))), s.picture)
    d = alerts.from_deviations(f)
    return d.select("scenario_id", "tick_us", "alert_key", "severity", F.concat_ws(",", "reason_codes").alias("reason_codes"), "summary")


# -- alerts -----------------------------------------------------------------


@query("h01_detection_union")
def h01(spark, sf):
    return live.detection_counts(sky(spark, sf))


@query("h02_last_detection_wins")
def h02(spark, sf):
    """Conflicts of several lookaheads under one key: per scan the longest, arriving last, stays."""
    # Lookaheads of a pair and scan are judged side by side: the last is known before any row is made.
    c = conflicts.in_blocks(sky(spark, sf).picture, lookahead_s=[120.0, 300.0], longest_only=True)
    d = alerts.from_conflicts(c, by=["lookahead_s"])
    return d.select("scenario_id", "alert_key", "tick_us", "lookahead_s", "severity")


@query("f06_alert_islands")
def f06(spark, sf):
    return live.alert_islands(sky(spark, sf))


@query("j09_alert_lifecycle")
def j09(spark, sf):
    a = live.alert_stream(sky(spark, sf))
    return a.select("scenario_id", "alert_id", "alert_key", "kind", "severity", "state", "raised_us", "updated_us", "summary",
                    F.concat_ws(",", "track_ids").alias("track_ids"), F.concat_ws(",", "reason_codes").alias("reason_codes"))


@query("d14_cleared_by_vanish")
def d14(spark, sf):
    s = sky(spark, sf)
    # Cleared at the very scan that finds a member gone: only then do both meet below.
    life = live.alert_stream(s, states=("cleared",)).where("by_vanish")
    cleared = life.select("scenario_id", "alert_key", "updated_us", "track_ids")
    gone = picture.vanished(s.updates, until_us=traffic.end_of_data(spark, sf)).select("scenario_id", "track_id", F.col("tick_us").alias("updated_us"))
    hit = cleared.withColumn("track_id", F.explode("track_ids")).join(gone, ["scenario_id", "track_id", "updated_us"])
    return hit.select("scenario_id", "alert_key", "track_id", "updated_us")


@query("f08_first_new_alert")
def f08(spark, sf):
    s = replay(spark, sf)
    r = evaluation.raised_alerts(conflicts.first_per_pair(s.picture))
    return r.select("scenario_id", "alert_key", "first_icao24", "second_icao24", "raised_us")


# -- truth and evaluation ---------------------------------------------------


@query("d06_truth_violations")
def d06(spark, sf):
    v = truth.violations(traffic.truth(spark, sf))
    return rnd(v.select("scenario_id", "sec", "first_icao24", "second_icao24", "horizontal_nm", "vertical_ft"), 4, "horizontal_nm", "vertical_ft")


@query("e03_truth_events")
def e03(spark, sf):
    return rnd(evaluation.truth_events(traffic.truth(spark, sf)), 4, "min_horizontal_nm", "min_vertical_ft")


@query("f05_event_islands")
def f05(spark, sf):
    e = evaluation.truth_events(traffic.truth(spark, sf))
    return e.groupBy("scenario_id").agg(F.count("*").alias("events"), F.max("event_no").alias("most"), F.sum(F.col("ended_s") - F.col("started_s")).alias("seconds"))


@query("g06_events_by_start")
def g06(spark, sf):
    e = evaluation.truth_events(traffic.truth(spark, sf))
    return e.select("scenario_id", "first_icao24", "second_icao24", "started_s").orderBy("started_s", "scenario_id", "first_icao24", "second_icao24")


@query("d07_matched_events")
def d07(spark, sf):
    s, t, _ = evaluation_inputs(spark, sf)
    r = evaluation.raised_alerts(conflicts.first_per_pair(s.picture))
    m = scoring.match(evaluation.truth_events(t), r, EPOCH)
    return m.select("scenario_id", "first_icao24", "second_icao24", "started_s", "detected", F.round("lead_s", 3).alias("lead_s"))


@query("d08_false_alerts")
def d08(spark, sf):
    s, t, _ = evaluation_inputs(spark, sf)
    r = evaluation.raised_alerts(conflicts.first_per_pair(s.picture))
    return scoring.false_alerts(r, evaluation.truth_events(t)).select("scenario_id", "alert_key", "raised_us")


@query("e05_conflict_scorecard")
def e05(spark, sf):
    s, t, sc = evaluation_inputs(spark, sf)
    return evaluation.conflict_evaluation(s, t, sc, EPOCH)


@query("k11_conflict_evaluation")
def k11(spark, sf):
    s, t, sc = evaluation_inputs(spark, sf)
    return evaluation.conflict_evaluation(s, t, sc, EPOCH, by=["family"])


@query("k15_manoeuvre_density")
def k15(spark, sf):
    s, t, sc = evaluation_inputs(spark, sf)
    return evaluation.conflict_evaluation(s, t, sc, EPOCH, by=["density"])


@query("k14_lookahead_sweep")
def k14(spark, sf):
    s, t, sc = evaluation_inputs(spark, sf)
    return evaluation.lookahead_sweep(s, t, sc, EPOCH, by=["family"])


@query("d12_sweep_detections")
def d12(spark, sf):
    c = conflicts.tallies(replay(spark, sf).picture, lookahead_s=evaluation.LOOKAHEADS_S)
    return c.groupBy("scenario_id", "lookahead_s").agg(F.sum("n").alias("n"), F.round(F.min("time_to_cpa_s"), 3).alias("soonest"))


@query("k13_detector_comparison")
def k13(spark, sf):
    s, t, sc = evaluation_inputs(spark, sf)
    return evaluation.detector_comparison(s, t, sc, EPOCH)


@query("e12_precision_bootstrap")
def e12(spark, sf):
    s, t, sc = evaluation_inputs(spark, sf)
    _, _, per = evaluation.threshold_outcomes(s, t, sc, EPOCH)
    return bootstrap.paired_precision_delta(per, arm="threshold", baseline=F.col("threshold") == -1.0)


def _forensics(spark, sf):
    s, t, _ = evaluation_inputs(spark, sf)
    return evaluation.forensics(s, t)


@query("d11_alerts_against_truth")
def d11(spark, sf):
    f = _forensics(spark, sf)
    return rnd(f.select("scenario_id", "alert_key", "ever_conflicted", "true_min_horizontal_nm", "horizontal_error_nm"), 3, "true_min_horizontal_nm", "horizontal_error_nm")


@query("e04_closest_approach")
def e04(spark, sf):
    s, t, _ = evaluation_inputs(spark, sf)
    r = evaluation.raised_alerts(conflicts.first_per_pair(s.picture))
    return rnd(truth.closest_approach(t, r), 4, "true_min_horizontal_nm", "true_vertical_at_closest_ft")


@query("e09_false_alert_profile")
def e09(spark, sf):
    return scoring.alert_profile(_forensics(spark, sf))


@query("k16_false_alert_forensics")
def k16(spark, sf):
    return scoring.near_misses(_forensics(spark, sf))


@query("e19_airspace_hours")
def e19(spark, sf):
    return scenario_table(spark, sf).groupBy("family").agg(F.count("*").alias("scenarios"), F.round(F.sum("duration_s") / 3600.0, 4).alias("hours"))


def _conformance(spark, sf):
    s, _, sc = evaluation_inputs(spark, sf)
    return evaluation.conformance_evaluation(s, traffic.manoeuvres(spark, sf), sc, EPOCH)


@query("d09_attributed_advisories")
def d09(spark, sf):
    return rnd(_conformance(spark, sf)[2], 3, "lag_s", "at_s")


@query("e06_conformance_scorecard")
def e06(spark, sf):
    return _conformance(spark, sf)[0]


@query("e07_recall_by_kind")
def e07(spark, sf):
    return scoring.recall_by(_conformance(spark, sf)[1], "kind")


@query("e08_recall_first_or_later")
def e08(spark, sf):
    return scoring.recall_by(_conformance(spark, sf)[1], "is_first")


@query("f10_manoeuvre_ordinal")
def f10(spark, sf):
    return _conformance(spark, sf)[1].groupBy("scenario_id", "kind", "is_first").agg(F.count("*").alias("n"), F.count("lag_s").alias("detected"))


@query("k12_conformance_evaluation")
def k12(spark, sf):
    out = _conformance(spark, sf)[1].join(scenario_table(spark, sf).select("scenario_id", "family"), "scenario_id")
    return scoring.recall_by(out, "family", "kind")


def load_all() -> dict:
    """Every registered query, including those of the sibling modules."""
    from wakeline.plans import registered_inputs, registered_models  # noqa: F401

    return QUERIES

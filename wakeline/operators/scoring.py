"""Detections against truth: matching, scorecards, attribution, forensics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions import labels
from wakeline.operators.quantiles import Quantile, quantiles
from wakeline.operators.slices import SLICE_S, drop_halo, with_halo
from wakeline.operators.truth import PAIR

# Fixed values that results depend on.
ATTRIBUTION_WINDOW_S = 240.0
MIN_FOR_TAIL = 10


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def first_raised(alerts: DataFrame, by: list[str] | None = None, evidence: list[str] | None = None) -> DataFrame:
    """First NEW conflict alert per key, as a sorted pair of aircraft."""
    arms = by or []
    new = alerts.where("kind = 'predicted_conflict' and state = 'new'")
    extra = [F.min_by(F.col(e), "raised_us").alias(e.split(".")[-1]) for e in (evidence or [])]
    ids = F.array_sort(F.transform("track_ids", lambda t: F.substring_index(t, "-", -1)))
    return new.groupBy(*arms, "scenario_id", "alert_key").agg(
        F.min("raised_us").alias("raised_us"), F.first(ids).alias("ids"), *extra
    ).select(
        *arms, "scenario_id", "alert_key", "raised_us",
        F.col("ids")[0].alias("first_icao24"), F.col("ids")[1].alias("second_icao24"),
        *[e.split(".")[-1] for e in (evidence or [])],
    )


def first_conflicts(found: DataFrame, by: list[str] | None = None, verdicts: dict[str, dict] | None = None, evidence: list[str] | None = None) -> DataFrame:
    """`first_raised` of the alerts of conflicts at scan ticks, without their lifecycle.

    A key's first detection opens its first spell, so its alert is raised then
    and has the evidence of that scan: a minimum a pair, combined before it is
    shuffled. `verdicts` names an arm with the conflict test of each of its
    values; rows are then pairs to judge, and are not repeated for each value.
    """
    arms, names = by or [], evidence or []
    pair = ["scenario_id", "first_track_id", "second_track_id"]
    tick = F.col("tick_us")
    if verdicts:
        ((arm, tests),) = verdicts.items()
        firsts = {f"_t{i}": F.min(F.when(test, tick)) for i, test in enumerate(tests.values())}
        per = found.groupBy(*pair).agg(*[c.alias(n) for n, c in firsts.items()])
        rows = [F.struct(F.lit(v).cast("double").alias(arm), F.col(n).alias("raised_us")) for v, n in zip(tests, firsts)]
        first = per.select(*pair, F.inline(F.array(*rows))).where("raised_us is not null")
        arms = [arm]
    else:
        first = found.groupBy(*arms, *pair).agg(F.min(tick).alias("raised_us"), *[F.min_by(F.col(e), tick).alias(e) for e in names])
    ids = F.array_sort(F.array(*[F.substring_index(c, "-", -1) for c in pair[1:]]))
    return first.select(
        *arms, "scenario_id", labels.pair_key(*pair[1:]).alias("alert_key"), "raised_us",
        ids[0].alias("first_icao24"), ids[1].alias("second_icao24"), *names,
    )


def match(events: DataFrame, raised: DataFrame, epoch_us: int, by: list[str] | None = None) -> DataFrame:
    """Every event beside the alert of its pair, with lead time when in time."""
    arms = by or []
    started = F.lit(epoch_us) + F.col("started_s").cast("long") * 1_000_000
    j = events.withColumn("started_us", started).join(raised, [*arms, *PAIR], "left")
    in_time = F.coalesce(F.col("raised_us") <= F.col("started_us"), F.lit(False))
    return j.withColumn("detected", in_time).withColumn(
        "lead_s", F.when(F.col("detected"), (F.col("started_us") - F.col("raised_us")) / 1e6)
    )


def lead_times(matched: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One lead time per alert: that of the last event it was in time for."""
    arms = by or []
    return matched.where("detected").groupBy(*arms, "scenario_id", "alert_key").agg(
        F.max_by("lead_s", "started_us").alias("lead_s")
    )


def false_alerts(raised: DataFrame, events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Alerts whose pair never conflicted; a late alert is not false."""
    arms = by or []
    return raised.join(events.select(*arms, *PAIR).distinct(), [*arms, *PAIR], "left_anti")


def expand_arms(df: DataFrame, arms: dict[str, list] | None) -> DataFrame:
    """Repeat rows for every value of every sweep arm (a few literals)."""
    for name, values in (arms or {}).items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v).cast("double") for v in values])))
    return df


def _null_safe(df: DataFrame, arms: list[str], back: bool = False) -> DataFrame:
    """Joins on an arm whose baseline is null go through a sentinel."""
    for a in arms:
        c = F.when(F.col(a) == -1.0, None).otherwise(F.col(a)) if back else F.coalesce(F.col(a), F.lit(-1.0))
        df = df.withColumn(a, c)
    return df


def outcomes(events: DataFrame, raised: DataFrame, scenarios: DataFrame, epoch_us: int, arms: dict[str, list] | None = None) -> DataFrame:
    """Per scenario (and arm): events, detected, alerts, false alerts."""
    names = list(arms or {})
    ev, al = _null_safe(expand_arms(events, arms), names), _null_safe(raised, names)
    ids = [*names, "scenario_id"]
    per_event = match(ev, al, epoch_us, names).groupBy(*ids).agg(
        F.count("*").alias("events"), F.count_if("detected").alias("detected")
    )
    per_alert = al.groupBy(*ids).agg(F.count("*").alias("alerts"))
    per_false = false_alerts(al, ev, names).groupBy(*ids).agg(F.count("*").alias("false_alerts"))
    base = _null_safe(expand_arms(scenarios, arms), names)
    out = base
    for part in (per_event, per_alert, per_false):
        out = out.join(part, ids, "left")
    return out.fillna(0, ["events", "detected", "alerts", "false_alerts"])


def conflict_scorecard(
    events: DataFrame, raised: DataFrame, scenarios: DataFrame, epoch_us: int, *, by: list[str] | None = None,
    arms: dict[str, list] | None = None,
) -> DataFrame:
    """Recall, precision, false-alert rate and lead times.

    `scenarios` has scenario_id, duration_s and any grouping columns in `by`;
    `arms` are sweep parameters every scenario was judged under.
    """
    groups, names = list(by or []), list(arms or {})
    keys = [*groups, *names]
    per = outcomes(events, raised, scenarios, epoch_us, arms)
    hours = F.sum("duration_s") / 3600.0
    ev, det = F.sum("events"), F.sum("detected")
    al, fa = F.sum("alerts"), F.sum("false_alerts")
    card = per.groupBy(*keys).agg(
        F.count("*").alias("scenarios"), F.round(hours, 2).alias("hours"),
        ev.alias("truth_events"), det.alias("detected_events"), F.round(ratio(det, ev), 4).alias("recall"),
        al.alias("alerts_raised"), fa.alias("false_alerts"), F.round(ratio(al - fa, al), 4).alias("precision"),
        F.round(ratio(fa, hours), 2).alias("false_alerts_per_hour"),
    )
    ev2, al2 = _null_safe(expand_arms(events, arms), names), _null_safe(raised, names)
    leads = lead_times(match(ev2, al2, epoch_us, names), names)
    if groups:
        leads = leads.join(scenarios.select("scenario_id", *groups), "scenario_id")
    stats = quantiles(
        leads, keys, "lead_s",
        [Quantile("lead_median_s", 0.5, "median"), Quantile("lead_p10_s", 0.1, min_count=MIN_FOR_TAIL),
         Quantile("lead_min_s", 0.0), Quantile("lead_max_s", 1.0)],
    ).withColumnRenamed("n", "lead_count")
    lead_cols = ["lead_median_s", "lead_p10_s", "lead_min_s", "lead_max_s"]
    joined = card.join(stats, keys, "left") if keys else _beside(card, stats)
    out = joined.withColumn("lead_count", F.coalesce("lead_count", F.lit(0)))
    for c in lead_cols:
        out = out.withColumn(c, F.round(c, 1))
    return _null_safe(out, names, back=True)


def _beside(one: DataFrame, other: DataFrame) -> DataFrame:
    """Left-join two ungrouped (single-row) summaries."""
    return one.withColumn("_k", F.lit(1)).join(other.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")


# -- conformance ------------------------------------------------------------

_AIRCRAFT = ["scenario_id", "icao24"]


def attribute(advisories: DataFrame, manoeuvres: DataFrame, window_s: float = ATTRIBUTION_WINDOW_S, slice_s: float = SLICE_S) -> DataFrame:
    """Each advisory (`at_s`) with the most recent manoeuvre at most `window_s` before it.

    An as-of join over the union of both streams, so no advisory meets more
    than one manoeuvre. Manoeuvres sort before advisories at the same instant.
    An aircraft is cut into time slices, which see manoeuvres of the window before.
    """
    # Of manoeuvres at one instant the first by name stands for all.
    m = manoeuvres.groupBy(*_AIRCRAFT, "at_s").agg(F.min("kind").alias("kind"))
    m = m.select(*_AIRCRAFT, "at_s", F.lit(0).alias("is_advisory"), F.struct("at_s", "kind").alias("m"))
    a = advisories.select(*_AIRCRAFT, "at_s", F.lit(1).alias("is_advisory"), F.lit(None).cast("struct<at_s:double,kind:string>").alias("m"))
    both = m.unionByName(a).withColumn("t_us", (F.col("at_s") * 1e6).cast("long"))
    seen = with_halo(both, before_s=window_s + 1.0, slice_s=slice_s)
    w = Window.partitionBy(*_AIRCRAFT, "slice").orderBy("at_s", "is_advisory").rowsBetween(Window.unboundedPreceding, 0)
    near = drop_halo(seen.withColumn("cause", F.last("m", ignorenulls=True).over(w))).where("is_advisory = 1")
    lag = F.col("at_s") - F.col("cause.at_s")
    ok = F.coalesce(lag <= window_s, F.lit(False))
    return near.select(
        *_AIRCRAFT, "at_s", ok.alias("attributed"),
        F.when(ok, F.col("cause.at_s")).alias("cause_at_s"), F.when(ok, F.col("cause.kind")).alias("cause_kind"),
        F.when(ok, lag).alias("lag_s"),
    )


def manoeuvre_outcomes(manoeuvres: DataFrame, attributed: DataFrame) -> DataFrame:
    """Every manoeuvre with its smallest detection lag and whether it is its aircraft's first."""
    credit = attributed.where("attributed").groupBy(
        *_AIRCRAFT, F.col("cause_at_s").alias("at_s"), F.col("cause_kind").alias("kind")
    ).agg(F.min("lag_s").alias("lag_s"))
    firsts = manoeuvres.groupBy(*_AIRCRAFT).agg(F.min(F.struct("at_s", "kind")).alias("f"))
    return (
        manoeuvres.join(credit, [*_AIRCRAFT, "at_s", "kind"], "left")
        .join(firsts, _AIRCRAFT)
        .select(
            *_AIRCRAFT, "at_s", "kind", "lag_s",
            ((F.col("at_s") == F.col("f.at_s")) & (F.col("kind") == F.col("f.kind"))).alias("is_first"),
        )
    )


def recall_by(outcome: DataFrame, *keys: str) -> DataFrame:
    n, d = F.count("*"), F.count("lag_s")
    return outcome.groupBy(*keys).agg(n.alias("manoeuvres"), d.alias("detected"), F.round(ratio(d, n), 4).alias("recall"))


def conformance_scorecard(outcome: DataFrame, attributed: DataFrame, scenarios: DataFrame) -> DataFrame:
    n, d = F.count("*"), F.count("lag_s")
    first_n, first_d = F.count_if("is_first"), F.count_if(F.col("is_first") & F.col("lag_s").isNotNull())
    m = outcome.agg(
        n.alias("manoeuvres"), d.alias("detected_manoeuvres"), F.round(ratio(d, n), 4).alias("recall"),
        F.round(ratio(first_d, first_n), 4).alias("recall_first"),
        F.round(ratio(d - first_d, n - first_n), 4).alias("recall_later"),
    )
    adv, good = F.count("*"), F.count_if("attributed")
    a = attributed.agg(
        adv.alias("advisories"), (adv - good).alias("unattributed"), F.round(ratio(good, adv), 4).alias("precision")
    )
    h = scenarios.agg(F.count("*").alias("scenarios"), (F.sum("duration_s") / 3600.0).alias("hours"))
    lags = quantiles(
        outcome.withColumn("lag_s", F.round("lag_s", 3)), [], "lag_s",
        [Quantile("lag_median_s", 0.5, "median"), Quantile("lag_p10_s", 0.1, min_count=MIN_FOR_TAIL),
         Quantile("lag_p90_s", 0.9, min_count=MIN_FOR_TAIL), Quantile("lag_max_s", 1.0)],
    ).withColumnRenamed("n", "lag_count")
    out = _beside(_beside(_beside(h, m), a), lags)
    out = out.withColumn("unattributed_per_hour", F.round(ratio(F.col("unattributed"), F.col("hours")), 2))
    for c in ("lag_median_s", "lag_p10_s", "lag_p90_s", "lag_max_s"):
        out = out.withColumn(c, F.round(c, 1))
    return out.withColumn("hours", F.round("hours", 2)).withColumn("lag_count", F.coalesce("lag_count", F.lit(0)))


# -- forensics --------------------------------------------------------------


def against_truth(raised: DataFrame, approach: DataFrame) -> DataFrame:
    """Alerts beside the closest their pair really came; unseen pairs are infinitely far."""
    inf = F.lit(float("inf"))
    return raised.join(approach, PAIR, "left").select(
        *raised.columns,
        F.coalesce("true_min_horizontal_nm", inf).alias("true_min_horizontal_nm"),
        F.coalesce("true_vertical_at_closest_ft", inf).alias("true_vertical_at_closest_ft"),
        F.coalesce("ever_conflicted", F.lit(False)).alias("ever_conflicted"),
    ).withColumn("horizontal_error_nm", F.col("true_min_horizontal_nm") - F.col("min_horizontal_sep_nm"))


def alert_profile(records: DataFrame) -> DataFrame:
    """Index quantiles of four measures for true and for false alerts."""
    long = records.selectExpr(
        "ever_conflicted",
        "stack(4, 'true_min_horizontal_nm', true_min_horizontal_nm, 'predicted_horizontal_nm', min_horizontal_sep_nm,"
        " 'horizontal_error_nm', horizontal_error_nm, 'time_to_cpa_s', time_to_cpa_s) as (measure, value)",
    )
    finite = long.where("value < double('infinity')")
    wanted = [Quantile("median", 0.5, "median"), Quantile("p10", 0.1), Quantile("p90", 0.9), Quantile("min", 0.0), Quantile("max", 1.0)]
    q = quantiles(finite, ["ever_conflicted", "measure"], "value", wanted, width=0.01)
    return q.select("ever_conflicted", "measure", "n", *[F.round(w.name, 2).alias(w.name) for w in wanted])


def near_misses(records: DataFrame, horizontal_nm: float = 5.0, vertical_ft: float = 1000.0) -> DataFrame:
    false = ~F.col("ever_conflicted")
    h, v = F.col("true_min_horizontal_nm"), F.col("true_vertical_at_closest_ft")
    return records.agg(
        F.count("*").alias("alerts"),
        F.count_if(~false).alias("true_alerts"),
        F.count_if(false).alias("false_alerts"),
        F.count_if(false & (h < 2 * horizontal_nm)).alias("within_two_standards"),
        F.count_if(false & (h < horizontal_nm) & (v >= vertical_ft)).alias("lateral_only"),
    )

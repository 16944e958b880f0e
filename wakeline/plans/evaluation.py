"""Detector and monitor evaluations against truth, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators import alerts, bootstrap, conflicts, conformance, scoring, truth
from wakeline.plans.live import Sky
from wakeline.session import cut_lineage

# Fixed values that results depend on.
LOOKAHEADS_S = [60.0, 120.0, 180.0, 240.0, 300.0]
THRESHOLDS = [None, 0.01, 0.05, 0.10, 0.20, 0.35, 0.50, 0.70]


def truth_events(truth_rows: DataFrame) -> DataFrame:
    """True conflict events; few, and read by every part of a scorecard."""
    return cut_lineage(truth.joined_parts(cut_lineage(truth.event_parts(truth_rows))))


def raised_alerts(found: DataFrame, by: list[str] | None = None, verdicts: dict[str, dict] | None = None,
                  evidence: list[str] | None = None) -> DataFrame:
    """First NEW alert per pair (and arm) for conflicts at scan ticks.

    Materialised: a scorecard reads the alerts several times, and the pair scan
    behind them is the expensive part.
    """
    return cut_lineage(scoring.first_conflicts(found, by, verdicts, evidence))


def conflict_evaluation(s: Sky, truth_rows: DataFrame, scenarios: DataFrame, epoch_us: int, by: list[str] | None = None) -> DataFrame:
    """Scorecard of the deterministic detector, overall or per scenario attribute."""
    raised = raised_alerts(conflicts.first_per_pair(s.picture))
    return scoring.conflict_scorecard(truth_events(truth_rows), raised, scenarios, epoch_us, by=by)


def lookahead_sweep(s: Sky, truth_rows: DataFrame, scenarios: DataFrame, epoch_us: int, by: list[str] | None = None) -> DataFrame:
    """The scorecard at every lookahead, from one pair join."""
    found = conflicts.first_per_pair(s.picture, lookahead_s=LOOKAHEADS_S)
    raised = raised_alerts(found, ["lookahead_s"])
    return scoring.conflict_scorecard(truth_events(truth_rows), raised, scenarios, epoch_us, by=by, arms={"lookahead_s": LOOKAHEADS_S})


def threshold_outcomes(s: Sky, truth_rows: DataFrame, scenarios: DataFrame, epoch_us: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, raised alerts, per-scenario outcomes) for every probability threshold."""
    pairs, verdicts = conflicts.judged_pairs(s.picture, THRESHOLDS)
    raised = raised_alerts(pairs, verdicts=verdicts)
    events = truth_events(truth_rows)
    per = scoring.outcomes(events, raised, scenarios, epoch_us, {"threshold": THRESHOLDS})
    return events, raised, cut_lineage(per)


def detector_comparison(s: Sky, truth_rows: DataFrame, scenarios: DataFrame, epoch_us: int,
                        resamples: int = bootstrap.PAIRED_RESAMPLES) -> DataFrame:
    """Scorecard per threshold beside its paired precision delta to the baseline."""
    events, raised, per = threshold_outcomes(s, truth_rows, scenarios, epoch_us)
    card = scoring.conflict_scorecard(events, raised, scenarios, epoch_us, arms={"threshold": THRESHOLDS})
    delta = bootstrap.paired_precision_delta(per, arm="threshold", baseline=F.col("threshold") == -1.0, resamples=resamples)
    return card.join(delta, "threshold", "left")


def forensics(s: Sky, truth_rows: DataFrame) -> DataFrame:
    """Every raised conflict alert beside what its pair really did."""
    found = conflicts.first_per_pair(s.picture)
    found = found.withColumnsRenamed({"min_horizontal_nm": "min_horizontal_sep_nm", "min_vertical_ft": "min_vertical_sep_ft"})
    raised = raised_alerts(found, evidence=["min_horizontal_sep_nm", "min_vertical_sep_ft", "time_to_cpa_s"])
    return scoring.against_truth(raised, truth.closest_approach(truth_rows, raised))


def advisories(s: Sky, epoch_us: int, predicted: DataFrame | None = None, calibration: DataFrame | None = None) -> DataFrame:
    """Every NEW non-conformance alert as (scenario, aircraft, seconds).

    `predicted` are a model's predictions instead of dead reckoning, and
    `calibration` its fitted typical errors instead of the fixed ones.
    """
    p = conformance.predictions(s.updates) if predicted is None else predicted
    found = conformance.per_scan(conformance.deviations(conformance.matured(p), calibration=calibration), s.picture)
    life = alerts.lifecycle(alerts.from_deviations(found), last_tick_us=s.until_us, sustain=False)
    return life.where("state = 'new'").select(
        "scenario_id", F.substring_index(F.col("track_ids")[0], "-", -1).alias("icao24"),
        ((F.col("raised_us") - epoch_us) / 1e6).alias("at_s"),
    )


def conformance_evaluation(s: Sky, manoeuvres: DataFrame, scenarios: DataFrame, epoch_us: int,
                           predicted: DataFrame | None = None, calibration: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scorecard, manoeuvre outcomes, attributed advisories)."""
    attributed = cut_lineage(scoring.attribute(advisories(s, epoch_us, predicted, calibration), manoeuvres))
    outcome = cut_lineage(scoring.manoeuvre_outcomes(manoeuvres, attributed))
    return scoring.conformance_scorecard(outcome, attributed, scenarios), outcome, attributed

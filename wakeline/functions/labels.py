"""Severity, reason codes and human-readable text for detections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wakeline.functions.geo import col

# Fixed values that results depend on.
WARNING_WITHIN_S, CAUTION_WITHIN_S, IMMINENT_WITHIN_S = 60.0, 180.0, 60.0
SEVERITY_RANK = {"warning": 0, "caution": 1, "advisory": 2, "info": 3}
LARGE_DEVIATION_FACTOR = 2.0


def present(*codes: Column) -> Column:
    """Array of the non-null codes, in order."""
    return F.filter(F.array(*codes), lambda c: c.isNotNull())


def pair_key(a, b) -> Column:
    first, second = F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b
    return F.concat_ws(":", F.lit("predicted_conflict"), F.least(first, second), F.greatest(first, second))


def conflict_severity(time_to_cpa_s) -> Column:
    t = col(time_to_cpa_s)
    return F.when(t <= WARNING_WITHIN_S, "warning").when(t <= CAUTION_WITHIN_S, "caution").otherwise("advisory")


def conflict_codes(time_to_cpa_s, current_horizontal_nm, horizontal_standard_nm) -> Column:
    t = col(time_to_cpa_s)
    return present(
        F.lit("horizontal_below_standard"),
        F.lit("vertical_below_standard"),
        F.when(t <= 0.0, "already_in_conflict").when(t < IMMINENT_WITHIN_S, "imminent"),
        F.when(col(current_horizontal_nm) < col(horizontal_standard_nm), "currently_within_horizontal_standard"),
    )


def conflict_summary(first_label: Column, second_label: Column, horizontal_nm, vertical_ft, time_to_cpa_s) -> Column:
    return F.format_string(
        "%s and %s: predicted separation %.1f NM / %.0f ft in %.0f s",
        first_label, second_label, col(horizontal_nm), col(vertical_ft), col(time_to_cpa_s),
    )


def deviation_codes(error_nm, threshold_nm, source) -> Column:
    return present(
        F.lit("prediction_error_above_threshold"),
        F.when(F.col(source) == "model", "model_prediction").otherwise("physics_prediction_only"),
        F.when(col(error_nm) > col(threshold_nm) * LARGE_DEVIATION_FACTOR, "large_deviation"),
    )


def deviation_summary(label: Column, error_nm, horizon_s, threshold_nm) -> Column:
    return F.format_string(
        "%s diverged %.1f NM from its %.0f s prediction (threshold %.1f NM). "
        "Advisory only: no flight plan is available, so this may be an entirely normal manoeuvre.",
        label, col(error_nm), col(horizon_s), col(threshold_nm),
    )


def severity_rank(severity) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])
    return F.element_at(ranks, F.col(severity))

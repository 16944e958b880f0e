"""Single-track rules: emergency codes and abnormal descents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.labels import present

# Fixed values that results depend on.
EMERGENCY_SQUAWKS = {
    "7500": ("unlawful interference", "squawk_7500_hijack"),
    "7600": ("radio failure", "squawk_7600_radio_failure"),
    "7700": ("general emergency", "squawk_7700_emergency"),
}
VERY_STEEP_FPM = -6000.0
LOW_ALTITUDE_FT = 10000.0
LOW_AND_STEEP_FPM = -3000.0

_ID = ["scenario_id", "tick_us", "track_id", "vanish_tick_us"]


def label() -> Column:
    return F.coalesce("callsign", "icao24")


def _lookup(position: int) -> Column:
    pairs = [F.lit(x) for code, v in EMERGENCY_SQUAWKS.items() for x in (code, v[position])]
    return F.element_at(F.create_map(*pairs), F.col("squawk"))


def emergency_squawks(tracks: DataFrame) -> DataFrame:
    hit = tracks.where(F.col("squawk").isin(*EMERGENCY_SQUAWKS))
    return hit.select(
        *_ID,
        F.lit("emergency_squawk").alias("kind"),
        F.lit("warning").alias("severity"),
        F.format_string("%s squawking %s (%s)", label(), "squawk", _lookup(0)).alias("summary"),
        F.array(_lookup(1)).alias("reason_codes"),
    )


def excessive_descents(tracks: DataFrame) -> DataFrame:
    rate, altitude = F.col("vertical_rate_fpm"), F.col("altitude_ft")
    very, low = rate <= VERY_STEEP_FPM, (altitude < LOW_ALTITUDE_FT) & (rate <= LOW_AND_STEEP_FPM)
    return tracks.where(very | low).select(
        *_ID,
        F.lit("excessive_descent").alias("kind"),
        F.when(low, "warning").otherwise("caution").alias("severity"),
        F.format_string(
            "%s descending at %s fpm through %s ft", label(),
            F.format_number(F.abs(F.bround(rate, 0)), 0), F.format_number(F.bround(altitude, 0), 0),
        ).alias("summary"),
        present(F.when(very, "descent_rate_above_6000_fpm"), F.when(low, "steep_descent_below_10000_ft")).alias("reason_codes"),
    )


def findings(tracks: DataFrame) -> DataFrame:
    """Every rule that fires on every track of the picture."""
    return emergency_squawks(tracks).unionByName(excessive_descents(tracks))

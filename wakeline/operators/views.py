"""Read models over track updates and alerts, and their idempotent sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions import labels
from wakeline.operators.bootstrap import draw

# Fixed values that results depend on.
LIVE_WINDOW_S = 20.0
TRACK_TTL_S = 120.0
ALERT_TTL_S = 300.0
HISTORY_LIMIT, HISTORY_MAX = 600, 5000
TRAIL_POINTS = 90
FRAME_PART = 500

TRACK = ["scenario_id", "track_id"]
POINT = [*TRACK, "t_us"]


def _latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Newest row per key; partial aggregation keeps a hot key cheap."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("r")).select(*keys, "r.*")


def history_points(updates: DataFrame, existing: DataFrame | None = None, seq: str | None = None) -> DataFrame:
    """New track points: the last of a batch wins, and what the table has stays."""
    cols = ["lat", "lon", "altitude_ft", "ground_speed_kt", "track_deg", "vertical_rate_fpm", "turn_rate_deg_s", "position_uncertainty_m"]
    tie = seq or "last_report_us"
    fresh = _latest(updates.select(*dict.fromkeys([*POINT, tie, *cols])), POINT, tie).select(*POINT, *cols)
    return fresh if existing is None else fresh.join(existing.select(*POINT), POINT, "left_anti")


def track_rows(updates: DataFrame, seq: str | None = None) -> DataFrame:
    """One row per track from a batch of updates."""
    order = F.struct("t_us", seq) if seq else F.struct("t_us", "update_count")
    new = F.struct("icao24", "callsign", F.col("t_us").alias("last_seen_us"), "state", "update_count")
    return updates.groupBy(*TRACK).agg(
        F.max_by(new, order).alias("n"), F.min("last_report_us").alias("first_seen_us")
    ).select(*TRACK, "n.icao24", "n.callsign", "first_seen_us", "n.last_seen_us", "n.state", "n.update_count")


def upsert_tracks(table: DataFrame, batch: DataFrame) -> DataFrame:
    """The table after a batch: first_seen never moves, an older batch never overwrites."""
    t, b = table.alias("t"), track_rows(batch).alias("b")
    newer = F.coalesce(F.col("b.last_seen_us") >= F.col("t.last_seen_us"), F.col("b.last_seen_us").isNotNull())

    def pick(c: str) -> Column:
        return F.when(newer, F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")).alias(c)

    return t.join(b, TRACK, "full_outer").select(
        *TRACK, F.coalesce("t.icao24", "b.icao24").alias("icao24"), pick("callsign"),
        F.coalesce("t.first_seen_us", "b.first_seen_us").alias("first_seen_us"),
        pick("last_seen_us"), pick("state"), pick("update_count"),
    )


def live_tracks(updates: DataFrame, as_of_us: int, window_s: float = LIVE_WINDOW_S) -> DataFrame:
    """Last write per track, without terminated or expired ones."""
    if not 0.0 < window_s <= 600.0:
        raise ValueError("window_s must be in (0, 600]")
    known = _latest(updates.where(F.col("t_us") <= as_of_us), TRACK, "t_us", "last_report_us")
    oldest = as_of_us - int(min(window_s, TRACK_TTL_S) * 1e6)
    return known.where((F.col("state") != "terminated") & (F.col("t_us") >= oldest))


def by_label(tracks: DataFrame) -> DataFrame:
    return tracks.orderBy(F.coalesce("callsign", "icao24"))


def latest_alerts(alerts: DataFrame, as_of_us: int) -> DataFrame:
    """The last publication of every alert key up to an instant."""
    state_order = F.when(F.col("state") == "new", 0).when(F.col("state") == "sustained", 1).otherwise(2)
    return _latest(
        alerts.where(F.col("updated_us") <= as_of_us).withColumn("_o", state_order), ["scenario_id", "alert_key"], "updated_us", "_o"
    ).drop("_o")


def still_running(latest: DataFrame, as_of_us: int, ttl_s: float = ALERT_TTL_S) -> DataFrame:
    """Of last publications, those of alerts that are neither cleared nor expired, newest first."""
    return latest.where((F.col("state") != "cleared") & (F.col("updated_us") >= as_of_us - int(ttl_s * 1e6))).orderBy(F.desc("updated_us"))


def active_alerts(alerts: DataFrame, as_of_us: int, kinds: list[str] | None = None, ttl_s: float = ALERT_TTL_S) -> DataFrame:
    """Alerts still running at an instant, newest first; no kinds means all."""
    known = latest_alerts(alerts, as_of_us)
    return still_running(known.where(F.col("kind").isin(*kinds)) if kinds else known, as_of_us, ttl_s)


def by_severity(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(labels.severity_rank("severity"), F.desc("updated_us"))


def newest_points(points: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Newest `limit` points of every track, in no order.

    A rank filter over the window is limited inside each map task as well, so
    a hot track ships at most `limit` rows per task.
    """
    if not 1 <= limit <= HISTORY_MAX:
        raise ValueError(f"limit must be in 1..{HISTORY_MAX}")
    w = Window.partitionBy(*TRACK).orderBy(F.desc("t_us"))
    return points.withColumn("age_rank", F.row_number().over(w)).where(F.col("age_rank") <= limit)


def history_tail(points: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Newest `limit` points of every track, to be read oldest first."""
    return newest_points(points, limit).orderBy(*TRACK, "t_us")


def trails(updates: DataFrame, points: int = TRAIL_POINTS) -> DataFrame:
    """Last `points` positions of every track, oldest first, as one array."""
    tail = newest_points(updates.where("state <> 'terminated'").select(*TRACK, "t_us", "lat", "lon", "altitude_ft"), points)
    dot = F.struct("t_us", "lat", "lon", "altitude_ft")
    return tail.groupBy(*TRACK).agg(F.array_sort(F.collect_list(dot)).alias("trail"))


def snapshot_frames(tracks: DataFrame, alerts: DataFrame, part_size: int = FRAME_PART) -> DataFrame:
    """The whole picture of every scenario as numbered document parts.

    A scenario has a part for each `part_size` of its tracks, and of its alerts,
    and entries are dealt to parts by a hash of their id, so no single row has
    to hold a whole sky.
    """

    def parts(df: DataFrame, ident: str, body: Column, what: str) -> DataFrame:
        size = df.groupBy("scenario_id").agg(F.count("*").alias("n"))
        n_parts = F.ceil(F.col("n") / part_size)
        return (
            df.join(size, "scenario_id")
            .groupBy("scenario_id", F.pmod(draw(5, F.col(ident)), n_parts).cast("int").alias("part"))
            .agg(F.array_sort(F.collect_list(body)).alias(what))
        )

    t = parts(tracks, "track_id", F.struct(F.coalesce("callsign", "icao24").alias("label"), "track_id", "lat", "lon", "altitude_ft", "state"), "tracks")
    a = parts(alerts, "alert_key", F.struct("alert_key", "kind", "severity", "state", "summary"), "alerts")
    return t.join(a, ["scenario_id", "part"], "full_outer").select(
        "scenario_id", "part", F.coalesce("tracks", F.array()).alias("tracks"), F.coalesce("alerts", F.array()).alias("alerts")
    )


def prunable(updates: DataFrame, as_of_us: int, older_than_s: float = 600.0) -> DataFrame:
    """Tracks whose state may be dropped: terminated and silent for long enough."""
    known = _latest(updates.where(F.col("t_us") <= as_of_us), TRACK, "t_us", "last_report_us")
    cutoff = as_of_us - int(older_than_s * 1e6)
    return known.where((F.col("state") == "terminated") & (F.col("last_report_us") < cutoff))

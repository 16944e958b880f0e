"""The airspace picture: which update describes each track at each scan tick."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.operators.slices import drop_halo, sliced_window, with_halo

# Fixed values that results depend on.
STALE_AFTER_S = 15.0
SCAN_INTERVAL_S = 1.0
MIN_UPDATES = 5
MAX_RADIUS_NM = 300.0

TRACK = ["scenario_id", "track_id"]


def validity(updates: DataFrame, *, tick_s: float = SCAN_INTERVAL_S, stale_s: float = STALE_AFTER_S) -> DataFrame:
    """Ticks each update is the current one, and the tick its track vanishes.

    An update rules from the first tick at or after it, until the next update
    of the track or until it is more than `stale_s` old. `vanish_tick_us` is
    the first tick that finds the track stale, null if an update came first.
    """
    tick, stale = int(tick_s * 1e6), int(stale_s * 1e6)
    seen = with_halo(updates, after_s=stale_s + tick_s)
    w = sliced_window(*TRACK)
    nxt = drop_halo(seen.withColumn("next_us", F.lead("t_us").over(w)))
    t, n = F.col("t_us"), F.col("next_us")
    gone = (F.floor((t + stale) / tick) + 1) * tick
    until = F.floor((t + stale) / tick) * tick
    return (
        nxt.where("state <> 'terminated'")
        .withColumn("vanish_tick_us", F.when(n.isNull() | (gone < n), gone))
        .withColumn("from_tick_us", F.ceil(t / tick) * tick)
        .withColumn("until_tick_us", F.least(until, F.coalesce((F.ceil(n / tick) - 1) * tick, until)))
        .drop("next_us")
    )


def at_ticks(updates: DataFrame, *, tick_s: float = SCAN_INTERVAL_S, stale_s: float = STALE_AFTER_S,
             until_us: int | None = None, within: tuple[int, int] | None = None) -> DataFrame:
    """One row per (track, scan tick) with the update that rules it.

    `within` names the first and last instant whose ticks are laid out; their rows are those of the whole picture.
    """
    tick = int(tick_s * 1e6)
    v = validity(updates, tick_s=tick_s, stale_s=stale_s)
    last = F.col("until_tick_us")
    if until_us is not None:
        last = F.least(last, F.lit(until_us))
        v = v.withColumn("vanish_tick_us", F.when(F.col("vanish_tick_us") <= until_us, F.col("vanish_tick_us")))
    first = F.col("from_tick_us")
    if within is not None:
        first, last = F.greatest(first, F.lit(-(-within[0] // tick) * tick)), F.least(last, F.lit(within[1]))
    v = v.where(first <= last)
    return v.withColumn("tick_us", F.explode(F.sequence(first, last, F.lit(tick)))).drop(
        "from_tick_us", "until_tick_us"
    )


def vanished(updates: DataFrame, *, tick_s: float = SCAN_INTERVAL_S, stale_s: float = STALE_AFTER_S,
             until_us: int | None = None) -> DataFrame:
    """Tracks that drop out of the picture because they went stale."""
    v = validity(updates, tick_s=tick_s, stale_s=stale_s).where(F.col("vanish_tick_us").isNotNull())
    if until_us is not None:
        v = v.where(F.col("vanish_tick_us") <= until_us)
    return v.select(*TRACK, F.col("vanish_tick_us").alias("tick_us"), F.col("t_us").alias("last_update_us"))


def eligible(picture: DataFrame, min_updates: int = MIN_UPDATES) -> DataFrame:
    """Tracks old enough to be tested for conflicts."""
    return picture.where(F.col("update_count") >= min_updates)


def frame_origins(tracks: DataFrame, *, circular: bool = False) -> DataFrame:
    """Shared tangent-plane origin per tick: the mean position of its tracks.

    The plain mean of longitudes is the default; `circular` stays correct when
    a picture straddles the date line.
    """
    lon = F.avg("lon")
    if circular:
        r = F.radians("lon")
        lon = F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r))))
    return tracks.groupBy("scenario_id", "tick_us").agg(
        F.avg("lat").alias("ref_lat"), lon.alias("ref_lon"), F.count("*").alias("tracks")
    )


def in_shared_frame(tracks: DataFrame, *, circular: bool = False) -> DataFrame:
    """Tracks with east/north position and velocity in their tick's shared frame."""
    origin = frame_origins(tracks, circular=circular)
    heading = F.radians("track_deg")
    return tracks.join(origin, ["scenario_id", "tick_us"]).select(
        "*",
        geo.enu_east("ref_lat", "ref_lon", "lat", "lon").alias("east_nm"),
        geo.enu_north("ref_lat", "lat").alias("north_nm"),
        (F.col("ground_speed_kt") * F.sin(heading)).alias("v_east_kt"),
        (F.col("ground_speed_kt") * F.cos(heading)).alias("v_north_kt"),
    )


def radius(tracks: DataFrame, limit_nm: float = MAX_RADIUS_NM) -> DataFrame:
    """Extent of every picture and whether its shared frame is too wide to trust."""
    r = F.max(F.hypot("east_nm", "north_nm"))
    return in_shared_frame(tracks).groupBy("scenario_id", "tick_us").agg(
        F.count("*").alias("tracks"), r.alias("radius_nm"), (r > limit_nm).alias("too_wide")
    )

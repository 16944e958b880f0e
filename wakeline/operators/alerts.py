"""Detections of every kind as one stream, and their raise/sustain/clear lifecycle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from wakeline.functions import labels
from wakeline.operators import segments
from wakeline.operators.slices import SLICE_S
from wakeline.session import cut_lineage

# Fixed values that results depend on.
CLEAR_AFTER_SCANS = 3
HEARTBEAT_S = 10.0

KEY = ["scenario_id", "alert_key"]


def from_conflicts(conflicts: DataFrame, horizontal_nm: float = 5.0, vertical_ft: float = 1000.0,
                   by: list[str] | None = None) -> DataFrame:
    """Detections for predicted conflicts; `by` names sweep arms to keep."""
    arms = [F.col(a) for a in by or []]
    first = F.coalesce("first_callsign", "first_track_id")
    second = F.coalesce("second_callsign", "second_track_id")
    return conflicts.select(
        *arms, "scenario_id", "tick_us", "vanish_tick_us",
        labels.pair_key("first_track_id", "second_track_id").alias("alert_key"),
        F.lit("predicted_conflict").alias("kind"),
        labels.conflict_severity("time_to_cpa_s").alias("severity"),
        labels.conflict_summary(first, second, "min_horizontal_nm", "min_vertical_ft", "time_to_cpa_s").alias("summary"),
        labels.conflict_codes("time_to_cpa_s", "current_horizontal_nm", F.lit(horizontal_nm)).alias("reason_codes"),
        F.array("first_track_id", "second_track_id").alias("track_ids"),
        F.struct(
            "time_to_cpa_s",
            F.col("min_horizontal_nm").alias("min_horizontal_sep_nm"),
            F.col("min_vertical_ft").alias("min_vertical_sep_ft"),
            "lookahead_s",
            F.lit(horizontal_nm).alias("horizontal_standard_nm"),
            F.lit(vertical_ft).alias("vertical_standard_ft"),
        ).alias("conflict"),
    )


def from_rules(findings: DataFrame) -> DataFrame:
    return findings.select(
        "scenario_id", "tick_us", "vanish_tick_us",
        F.concat_ws(":", "kind", "track_id").alias("alert_key"),
        "kind", "severity", "summary", "reason_codes", F.array("track_id").alias("track_ids"),
    )


def from_deviations(findings: DataFrame) -> DataFrame:
    """One advisory detection per track and scan (see `conformance.per_scan`)."""
    who = F.coalesce("callsign", "track_id")
    return findings.select(
        "scenario_id", "tick_us", "vanish_tick_us",
        F.concat_ws(":", F.lit("non_conformance"), "track_id").alias("alert_key"),
        F.lit("non_conformance").alias("kind"),
        F.lit("advisory").alias("severity"),
        labels.deviation_summary(who, "error_nm", "horizon_s", "threshold_nm").alias("summary"),
        labels.deviation_codes("error_nm", "threshold_nm", "source").alias("reason_codes"),
        F.array("track_id").alias("track_ids"),
        F.struct(
            F.col("predicted_us"), F.col("horizon_s"), F.col("error_nm"), F.col("baseline_error_nm"),
            F.col("threshold_nm"), F.col("predictor_version"),
        ).alias("conformance"),
    )


def union(*detections: DataFrame) -> DataFrame:
    """Heterogeneous detections in one schema; evidence a kind lacks is null."""
    out = detections[0]
    for d in detections[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def last_per_scan(detections: DataFrame, arrival: str) -> DataFrame:
    """One detection per key and scan: the last to arrive wins."""
    ids = [*KEY, "tick_us"]
    rest = [c for c in detections.columns if c not in ids]
    return (
        detections.groupBy(*ids)
        .agg(F.max_by(F.struct(*rest), F.col(arrival)).alias("d"))
        .select(*ids, "d.*")
    )


def with_islands(detections: DataFrame, *, by: list[str] | None = None, tick_s: float = 1.0,
                 clear_after: int = CLEAR_AFTER_SCANS, slice_s: float = SLICE_S) -> DataFrame:
    """Mark the uninterrupted spell (island) every detection belongs to.

    A spell survives fewer than `clear_after` missed scans, and ends at once
    when a member track vanishes. Adds `raised_us`, `opens` and `clear_us`
    (the scan that clears the spell, on its last detection only). There is at
    most one row per key and scan; a key is scanned slice by slice, so one that
    alerts for ever is not one task's work.
    """
    tick, arms = int(tick_s * 1e6), by or []
    keys = [*arms, *KEY]
    t, prev, nxt = F.col("tick_us"), F.col("prev.tick_us"), F.col("next.tick_us")
    limit = (clear_after + 1) * tick
    beside = segments.neighbours(segments.sliced(detections, "tick_us", slice_s * 1e6), keys, "tick_us", ["tick_us", "vanish_tick_us"], arms)
    opens = prev.isNull() | (t - prev >= limit) | F.coalesce(F.col("prev.vanish_tick_us") < t, F.lit(False))
    ends = nxt.isNull() | (nxt - t >= limit) | F.coalesce(F.col("vanish_tick_us") < nxt, F.lit(False))
    marked = beside.select(*detections.columns, segments.SLICE, opens.alias("opens"), F.when(ends, F.least(t + clear_after * tick, F.col("vanish_tick_us"))).alias("clear_us"))
    return segments.filled(marked, keys, "tick_us", "raised_us", F.when(F.col("opens"), t), arms)


def _parts(batches: Iterator[pa.RecordBatch], names: list[str], limit_us: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Detections of a key and slice, in order, cut where a spell ends: the ticks of each part and its last vanishing."""
    for batch in batches:
        seen = batch.column("seen")
        flat, lengths = seen.flatten(), pc.list_value_length(seen).to_numpy()
        ticks, vanish = flat.field("tick_us").to_numpy(), flat.field("vanish_tick_us")
        if not len(ticks):
            continue
        gone = vanish.fill_null(np.iinfo(np.int64).max).to_numpy()
        opens = np.zeros(len(ticks), bool)
        opens[np.cumsum(lengths) - lengths] = True
        opens[1:] |= (np.diff(ticks) >= limit_us) | (gone[:-1] < ticks[1:])
        first = np.flatnonzero(opens)
        after = np.append(first[1:], len(ticks))
        row = pa.array(np.repeat(np.arange(len(lengths)), lengths)[first])
        own = {n: batch.column(n).take(row) for n in names}
        own |= {
            "ticks": pa.ListArray.from_arrays(pa.array(np.append(first, len(ticks)), pa.int32()), pa.array(ticks)),
            "first_us": pa.array(ticks[first]), "last_us": pa.array(ticks[after - 1]), "last_vanish_us": vanish.take(pa.array(after - 1)),
        }
        yield pa.RecordBatch.from_arrays([own[f.name].cast(f.type) for f in schema], schema=schema)


def _publications(ticks: np.ndarray, last: int, every_us: int) -> list[int]:
    """Places in `ticks` that are published, each the first at least `every_us` after the one before, from `last` on."""
    out, at = [], 0
    while (at := at + int(np.searchsorted(ticks[at:], last + every_us))) < len(ticks):
        out.append(at)
        last = int(ticks[at])
    return out


def _summaries(batches: Iterator[pa.RecordBatch], names: list[str], every_us: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """For each part of a spell: the ticks that may be its first publication, and the last publication each leads to."""
    for batch in batches:
        starts, exits = [], []
        for seen in batch.column("ticks"):
            ticks = seen.values.to_numpy()
            # The publication before was made at the part's first tick at the latest.
            own = ticks[: int(np.searchsorted(ticks, ticks[0] + every_us)) + 1]
            starts.append(own.tolist())
            exits.append([int(ticks[p[-1]]) if (p := _publications(ticks, int(s), every_us)) else int(s) for s in own])
        own = {"starts": pa.array(starts, pa.list_(pa.int64())), "exits": pa.array(exits, pa.list_(pa.int64()))} | {n: batch.column(n) for n in names}
        yield pa.RecordBatch.from_arrays([own[f.name].cast(f.type) for f in schema], schema=schema)


def _chained(batches: Iterator[pa.RecordBatch], names: list[str], every_us: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Of each part in order of slice, the publication before it. A spell is published when it is raised."""
    key, last = None, 0
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            if (own := tuple(r[k] for k in names)) != key:
                key, last = own, r["raised_us"]
            r["published_us"] = last
            start = int(np.searchsorted(r["starts"], last + every_us))
            last = r["exits"][start] if start < len(r["starts"]) else last
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def _beats(batches: Iterator[pa.RecordBatch], every_us: int) -> Iterator[pa.RecordBatch]:
    """Add the ticks of each part that are published, from the publication before the part on."""
    for batch in batches:
        found = []
        for seen, last in zip(batch.column("ticks"), batch.column("published_us").to_pylist()):
            ticks = seen.values.to_numpy()
            found.append(ticks[_publications(ticks, last, every_us)].tolist())
        kept = [n for n in batch.schema.names if n != "ticks"]
        beats = pa.array(found, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], beats], names=[*kept, "beats"])


def _fields(df: DataFrame, *names: str) -> list[StructField]:
    return [df.schema[n] for n in names]


def spells(detections: DataFrame, *, by: list[str] | None = None, tick_s: float = 1.0, clear_after: int = CLEAR_AFTER_SCANS,
           slice_s: float = SLICE_S) -> DataFrame:
    """The spells of `with_islands` in parts, a row for each slice that a spell touches.

    Has the part's `ticks`, `first_us`, `last_us`, `raised_us` of the spell, `opens`
    and `clear_us` (on a spell's last part only). Keys and ticks are dealt once;
    what follows moves one row a part.
    """
    tick, arms = int(tick_s * 1e6), by or []
    keys, limit = [*arms, *KEY], (clear_after + 1) * tick
    ids = [*keys, segments.SLICE]
    rows = segments.sliced(detections.select(*keys, "tick_us", "vanish_tick_us"), "tick_us", slice_s * 1e6)
    seen = rows.groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct("tick_us", "vanish_tick_us"))).alias("seen"))
    times = [StructField(n, LongType()) for n in ("first_us", "last_us", "last_vanish_us")]
    schema = StructType([*_fields(seen, *ids), StructField("ticks", ArrayType(LongType())), *times])
    arrow = to_arrow_schema(schema)
    parts = cut_lineage(seen.mapInArrow(lambda it: _parts(it, ids, limit, arrow), schema))
    along = Window.partitionBy(*keys).orderBy(segments.SLICE, "first_us")
    first, last = F.col("first_us"), F.col("last_us")
    before, gone = F.lag("last_us").over(along), F.lag("last_vanish_us").over(along)
    opens = before.isNull() | (first - before >= limit) | F.coalesce(gone < first, F.lit(False))
    chain = parts.drop("ticks").withColumn("opens", opens)
    ends = F.coalesce(F.lead("opens").over(along), F.lit(True))
    chain = chain.select(
        *ids, first.alias("_first_us"), "opens",
        F.last(F.when(F.col("opens"), first), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("raised_us"),
        F.when(ends, F.least(last + clear_after * tick, F.col("last_vanish_us"))).alias("clear_us"),
    )
    return _inherit(parts, chain, [*ids, "first_us"], {"first_us": "_first_us"}, arms)


def _inherit(rows: DataFrame, other: DataFrame, keys: list[str], renamed: dict[str, str], nullable: list[str], how: str = "inner") -> DataFrame:
    """Rows with the columns of `other` that are not keys; `nullable` keys may be null."""
    names = {k: renamed.get(k, k) for k in keys}
    other = other.select(*[F.col(n).alias(f"_k_{k}") for k, n in names.items()], *[c for c in other.columns if c not in names.values()])
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k).eqNullSafe(F.col(f"_k_{k}")) if k in nullable else F.col(k) == F.col(f"_k_{k}"))
    return rows.join(other, on, how).drop(*[f"_k_{k}" for k in keys])


def with_beats(parts: DataFrame, *, by: list[str] | None = None, every_s: float = HEARTBEAT_S) -> DataFrame:
    """Rows of `spells` with `beats`, the ticks that republish a running alert, instead of `ticks`.

    Each publication depends on the one before, along the whole spell. What a
    part does to it is a small table: for each of the few ticks that may
    be published first, the last one that then is. Tables are chained along a
    spell of several parts, and every part is replayed from what it inherits.
    """
    arms = by or []
    names, every = [*arms, *KEY, "raised_us"], int(every_s * 1e6)
    ids = [*names, segments.SLICE]
    keyed = _fields(parts, *ids)
    table = StructType([*keyed, StructField("starts", ArrayType(LongType())), StructField("exits", ArrayType(LongType()))])
    chain = StructType([*keyed, StructField("published_us", LongType())])
    table_arrow, chain_arrow = to_arrow_schema(table), to_arrow_schema(chain)
    width = max(1, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # A spell of one part is published when it is raised; only the others are chained.
    several = parts.where("not opens or clear_us is null").select(*ids, "ticks")
    summed = several.mapInArrow(lambda it: _summaries(it, ids, every, table_arrow), table)
    linked = summed.repartition(width, *names).sortWithinPartitions(*ids).mapInArrow(lambda it: _chained(it, names, every, chain_arrow), chain)
    started = _inherit(parts, linked, ids, {}, arms, "left").withColumn("published_us", F.coalesce("published_us", "raised_us"))
    schema = StructType([*[f for f in started.schema.fields if f.name != "ticks"], StructField("beats", ArrayType(LongType()))])
    return started.mapInArrow(lambda it: _beats(it, every), schema).drop("published_us")


def lifecycle(
    detections: DataFrame, *, last_tick_us: int, by: list[str] | None = None, tick_s: float = 1.0,
    clear_after: int = CLEAR_AFTER_SCANS, heartbeat_s: float = HEARTBEAT_S, sustain: bool = True, slice_s: float = SLICE_S,
    labelled: Callable[[DataFrame, list[str]], DataFrame] | None = None,
) -> DataFrame:
    """NEW, SUSTAINED and CLEARED alerts for detections at scan ticks, at most one for a key and scan.

    `by` names extra columns (sweep arms) that keep independent lifecycles.
    Detections are worked out once. Spells are made from their keys and ticks,
    and only what is published takes the rest of its detection. `labelled` makes
    detections of published rows that have only their evidence, and keeps the
    columns it is told.
    """
    arms = by or []
    keys, told = [*arms, *KEY], ["raised_us", "state", "updated_us"]
    detections = cut_lineage(detections)
    parts = spells(detections, by=arms, tick_s=tick_s, clear_after=clear_after, slice_s=slice_s)
    parts = with_beats(parts, by=arms, every_s=heartbeat_s) if sustain else parts.withColumn("beats", F.array().cast("array<bigint>"))

    def news(state: str, at: Column, updated: Column) -> Column:
        return F.struct(F.lit(state).alias("state"), at.alias("at_us"), updated.alias("updated_us"))

    first, last = F.col("first_us"), F.col("last_us")
    published = F.concat(
        F.when(F.col("opens"), F.array(news("new", first, first))).otherwise(F.array()),
        F.transform("beats", lambda t: news("sustained", t, t)),
        F.when(F.col("clear_us") <= last_tick_us, F.array(news("cleared", last, F.col("clear_us")))).otherwise(F.array()),
    )
    told_rows = parts.select(*keys, "raised_us", F.inline(published))
    rows = _inherit(detections, told_rows, [*keys, "tick_us"], {"tick_us": "at_us"}, arms)
    if labelled is not None:
        rows = labelled(rows, [*arms, *told])
    return _as_published(rows, arms)


def _as_published(rows: DataFrame, arms: list[str]) -> DataFrame:
    """Alerts of labelled detections that have their `state`, `raised_us` and `updated_us`."""
    evidence = [c for c in ("conflict", "conformance") if c in rows.columns]
    return rows.select(
        *arms,
        "scenario_id",
        F.sha2(F.concat_ws("|", *arms, "scenario_id", "alert_key", "raised_us"), 256).alias("alert_id"),
        "alert_key", "kind", "severity", "state", "raised_us", "updated_us", "track_ids", "reason_codes",
        F.when(F.col("state") == "cleared", F.concat(F.lit("Cleared: "), "summary")).otherwise(F.col("summary")).alias("summary"),
        *evidence,
        (F.coalesce(F.col("updated_us") == F.col("vanish_tick_us"), F.lit(False)) & (F.col("state") == "cleared")).alias("by_vanish"),
    )


SCAN = {"tick_us": 1_000_000, "clear_after": CLEAR_AFTER_SCANS, "every_us": int(HEARTBEAT_S * 1e6)}


def of_spells(spells: DataFrame, last_tick_us: int) -> DataFrame:
    """`conflict_lifecycle` from `conflicts.alert_spells`."""
    told = spells.where((F.col("state") != "cleared") | (F.col("updated_us") <= last_tick_us))
    return _as_published(from_conflicts(told, by=["raised_us", "state", "updated_us"]), [])


def conflict_lifecycle(conflicts: DataFrame, *, by: list[str] | None = None, **kwargs) -> DataFrame:
    """`lifecycle` of `from_conflicts`; texts are made of published conflicts only."""
    keyed = conflicts.withColumn("alert_key", labels.pair_key("first_track_id", "second_track_id"))
    return lifecycle(keyed, by=by, labelled=lambda rows, told: from_conflicts(rows, by=told), **kwargs)


def running_span(as_of_us: int, last_tick_us: int, tick_s: float = 1.0, clear_after: int = CLEAR_AFTER_SCANS) -> tuple[int, int]:
    """First and last instant of the detections that decide which alerts run at `as_of_us`."""
    now = min(as_of_us, last_tick_us)
    return now - clear_after * int(tick_s * 1e6) + 1, now


def running_at(detections: DataFrame, as_of_us: int, *, last_tick_us: int, tick_s: float = 1.0, clear_after: int = CLEAR_AFTER_SCANS) -> DataFrame:
    """Keys with an alert that `lifecycle` has raised and not cleared by an instant, and the tracks it names.

    A spell is cleared `clear_after` scans after its last detection, or when a
    member track vanishes, and the next detection then comes later. So an alert
    runs just if the key's last detection up to the instant is younger than
    that and its tracks are still there.
    """
    first, now = running_span(as_of_us, last_tick_us, tick_s, clear_after)
    recent = detections.where(F.col("tick_us").between(first, now))
    last = recent.groupBy(*KEY).agg(F.max_by(F.struct("vanish_tick_us", "track_ids"), "tick_us").alias("d"))
    return last.where(F.coalesce(F.col("d.vanish_tick_us") > now, F.lit(True))).select(*KEY, "d.track_ids")


def hit_by_vanished(active: DataFrame, vanished_tracks: DataFrame) -> DataFrame:
    """Alerts of which a member track vanished, with the vanishing track."""
    members = active.withColumn("track_id", F.explode("track_ids"))
    return members.join(vanished_tracks, ["scenario_id", "track_id"])


def flag_alerted(tracks: DataFrame, active: DataFrame) -> DataFrame:
    """Tracks with a flag telling whether an active alert names them."""
    named = active.select("scenario_id", F.explode("track_ids").alias("track_id")).distinct().withColumn("alerted", F.lit(True))
    return tracks.join(named, ["scenario_id", "track_id"], "left").withColumn("alerted", F.coalesce("alerted", F.lit(False)))

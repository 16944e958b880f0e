"""Predict and check on a stream of track updates: each prediction waits in state for the update that resolves it.

State is the list of a track's pending predictions, oldest first, and the time
of its last update. An update resolves the predictions it comes in time for,
and drops those it comes too late for, or all of them if its track had vanished
in between. An event-time timer behind the newest prediction drops what a
silent track leaves, and with it the last of its state.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wakeline.operators import conformance
from wakeline.operators.picture import SCAN_INTERVAL_S, STALE_AFTER_S

KEY = ["scenario_id", "track_id"]
_MADE = ["t_us", "p_lat", "p_lon", "b_lat", "b_lon", "source"]
_PENDING = "t_us long, p_lat double, p_lon double, b_lat double, b_lon double, source string"
_SEEN = ["icao24", "callsign", "lat", "lon"]
_OUT = "scenario_id string, track_id string, t_us long, p_lat double, p_lon double, b_lat double, b_lon double, source string, matched_us long, icao24 string, callsign string, hit_lat double, hit_lon double"
_TICK, _STALE = int(SCAN_INTERVAL_S * 1e6), int(STALE_AFTER_S * 1e6)


def resolve(pending: list[tuple], last_us: int | None, updates: Iterable[tuple], lo_us: int, hi_us: int) -> tuple[list[tuple], int | None, list[tuple]]:
    """Pending predictions and last time after `updates` (made prediction, seen values), and what they resolved.

    `updates` are in order of time; one not newer than the last is ignored.
    """
    done = []
    for made, seen in updates:
        t = made[0]
        if last_us is not None:
            if t <= last_us:
                continue
            if ((last_us + _STALE) // _TICK + 1) * _TICK < t:
                pending = []
        first = 0
        while first < len(pending) and pending[first][0] + lo_us <= t:
            if t <= pending[first][0] + hi_us:
                done.append((*pending[first], t, *seen))
            first += 1
        pending = [*pending[first:], made]
        last_us = t
    return pending, last_us, done


class CheckProcessor(StatefulProcessor):
    """Pending predictions of one track."""

    def __init__(self, horizon_s: float, tolerance_s: float) -> None:
        self._lo, self._hi = int((horizon_s - tolerance_s) * 1e6), int((horizon_s + tolerance_s) * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._pending = handle.getListState("pending", _PENDING)
        self._last = handle.getValueState("last", "t_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values("t_us", kind="stable")
        batch = batch.astype(object).where(batch.notna(), None)
        updates = zip(batch[_MADE].itertuples(index=False, name=None), batch[_SEEN].itertuples(index=False, name=None))
        last = self._last.get()[0] if self._last.exists() else None
        held = [tuple(p) for p in self._pending.get()] if self._pending.exists() else []
        pending, last, done = resolve(held, last, updates, self._lo, self._hi)
        self._pending.put(pending)
        self._last.update((last,))
        for t in list(self._handle.listTimers()):
            self._handle.deleteTimer(t)
        self._handle.registerTimer((last + self._hi) // 1000 + 1)
        yield pd.DataFrame([(*key, *d) for d in done], columns=[c.split()[0] for c in _OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # No update came in time for the newest prediction, so none did for any.
        self._pending.clear()
        self._last.clear()
        yield pd.DataFrame(columns=[c.split()[0] for c in _OUT.split(", ")])

    def close(self) -> None:
        pass


def matured_stream(updates: DataFrame, *, horizon_s: float = conformance.HORIZON_S, tolerance_s: float = conformance.MATCH_TOLERANCE_S, late: str = "10 seconds") -> DataFrame:
    """Streaming counterpart of :func:`wakeline.operators.conformance.matured` over its predictions for `updates`.

    A check is emitted when the update that resolves it arrives; it waits for no
    watermark. Updates of a track that arrive behind newer ones are ignored.
    """
    made = conformance.predictions(updates.where("state <> 'terminated'"), horizon_s)
    timed = made.select(*KEY, *_MADE, *_SEEN).withColumn("updated_at", F.timestamp_micros("t_us")).withWatermark("updated_at", late)
    found = timed.groupBy(*KEY).transformWithStateInPandas(
        statefulProcessor=CheckProcessor(horizon_s, tolerance_s), outputStructType=_OUT, outputMode="Append", timeMode="EventTime"
    )
    hit = F.struct(F.col("matched_us").alias("t_us"), F.col("hit_lat").alias("lat"), F.col("hit_lon").alias("lon"), F.col("callsign"))
    return conformance.judged(found.select(*KEY, "icao24", "t_us", "p_lat", "p_lon", "b_lat", "b_lon", "source", F.lit(horizon_s).alias("horizon_s"), hit.alias("hit")))

"""Track estimation on a stream: the batch fold as a stateful processor.

State is one flight per aircraft. Event-time timers at the last report +5 s
and +30 s announce coasting and termination when no report came; termination
also drops the state, so nothing is kept for aircraft that left. Reports behind
the watermark never arrive here, and a report that is not newer than the state
is ignored by the fold itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wakeline.functions import kalman as kf
from wakeline.operators import tracking as tr

_STATE = (
    "bank array<double>, ref_lat double, ref_lon double, t_us long, segment_us long, n int, heading double, turn_rate double, "
    "innovation double, callsign string, squawk string, announced int"
)
_COLUMNS = [f[0] for f in tr._FIELDS]


def _frame(parts: list[dict]) -> pd.DataFrame:
    """Fold output as one pandas frame in output column order."""
    frames = []
    for p in parts:
        p = dict(p)
        p["track_id"] = np.array(["trk-" + x for x in p["icao24"]], dtype=object)
        frames.append(pd.DataFrame({c: p[c] for c in _COLUMNS}))
    return pd.concat(frames, ignore_index=True).sort_values("t_us") if frames else pd.DataFrame(columns=_COLUMNS)


class TrackProcessor(StatefulProcessor):
    """One flight per (scenario, aircraft)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._flight = handle.getValueState("flight", _STATE)
        self._tuning = kf.Tuning()

    def _load(self, key) -> tuple[tr.Flight | None, int]:
        if not self._flight.exists():
            return None, 0
        bank, la, lo, t, seg, n, h, turn, inn, cs, sq, announced = self._flight.get()
        return tr.Flight(tuple(key), np.array([bank], dtype=np.float64), la, lo, t, seg, n, h, turn, inn, cs, sq), announced

    def _store(self, f: tr.Flight, announced: int) -> None:
        self._flight.update((
            [float(x) for x in f.bank[0]], f.ref_lat, f.ref_lon, f.t_us, f.segment_us, f.count, f.heading, f.turn_rate,
            f.innovation, f.callsign, f.squawk, announced,
        ))

    def _arm(self, t_us: int) -> None:
        for t in list(self._handle.listTimers()):
            self._handle.deleteTimer(t)
        for after in (tr.COAST_AFTER_S, tr.TERMINATE_AFTER_S):
            self._handle.registerTimer(-(-t_us // 1000) + int(after * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["t_us", "report_id"])
        flight, announced = self._load(key)
        cols = {c: batch[c].to_numpy(dtype=np.float64) for c in tr._MEASURES[1:]}
        cols["t_us"] = batch["t_us"].to_numpy(dtype=np.int64)
        for c in tr._TEXTS:
            cols[c] = batch[c].astype(object).where(batch[c].notna(), None).to_numpy(dtype=object)
        for c, v in zip(tr.KEY, key):
            cols[c] = np.full(len(batch), v, dtype=object)
        before = flight.t_us if flight is not None else None
        parts, after = tr.fold(cols, flight, self._tuning)
        out = _frame([p for p in parts if "state" in p])
        if announced and len(out):
            # Timers already told about this silence.
            told = ["coasting", "terminated"][:announced]
            out = out[~(out["state"].isin(told) & (out["last_report_us"] == before))]
        moved = before is None or after.t_us > before
        self._store(after, 0 if moved else announced)
        if moved:
            self._arm(after.t_us)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        flight, announced = self._load(key)
        if flight is None:
            yield _frame([])
            return
        silence_s = (expiredTimerInfo.getExpiryTimeInMs() * 1000 - flight.t_us) / 1e6
        parts = tr.silence(flight, silence_s, self._tuning)[announced:]
        if silence_s >= tr.TERMINATE_AFTER_S:
            self._flight.clear()
        else:
            self._store(flight, 1)
        yield _frame(parts)

    def close(self) -> None:
        pass


def track_updates_stream(reports: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Streaming counterpart of :func:`wakeline.operators.tracking.track_updates`.

    `reports` is a streaming frame with the batch columns. Partitioned by
    aircraft; the number of state partitions is fixed at the first run.
    """
    timed = reports.select(*tr.INPUT_COLUMNS).withColumn("observed_at", F.timestamp_micros("t_us")).withWatermark("observed_at", late)
    return timed.groupBy(*tr.KEY).transformWithStateInPandas(
        statefulProcessor=TrackProcessor(), outputStructType=tr.TRACK_SCHEMA, outputMode="Append", timeMode="EventTime"
    )

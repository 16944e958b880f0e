"""Alert lifecycle on a stream of detections.

State is one running alert per key. A timer at the scan that would clear it
(three misses, or the moment a member track vanishes) does the clearing when
no further detection came.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wakeline.operators.alerts import CLEAR_AFTER_SCANS, HEARTBEAT_S, KEY

_TICK_US = 1_000_000
_OUT = "scenario_id string, alert_key string, state string, raised_us long, updated_us long, payload string"
_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]


class AlertProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._alert = handle.getValueState("alert", "raised_us long, last_pub_us long, last_us long, clear_us long, payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values("tick_us")
        current = tuple(self._alert.get()) if self._alert.exists() else None
        out = []
        for tick, vanish, payload in zip(batch["tick_us"], batch["vanish_tick_us"], batch["payload"]):
            tick = int(tick)
            clear = tick + CLEAR_AFTER_SCANS * _TICK_US
            if vanish is not None and vanish == vanish:
                clear = min(clear, int(vanish))
            if current is not None and tick > current[3]:
                out.append((*key, "cleared", current[0], current[3], current[4]))
                current = None
            if current is None:
                out.append((*key, "new", tick, tick, payload))
                current = (tick, tick, tick, clear, payload)
            elif tick > current[2]:
                last_pub = current[1]
                if tick - last_pub >= HEARTBEAT_S * 1e6:
                    out.append((*key, "sustained", current[0], tick, payload))
                    last_pub = tick
                current = (current[0], last_pub, tick, clear, payload)
        self._alert.update(current)
        for t in list(self._handle.listTimers()):
            self._handle.deleteTimer(t)
        self._handle.registerTimer(current[3] // 1000)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        if self._alert.exists():
            current = tuple(self._alert.get())
            out.append((*key, "cleared", current[0], current[3], current[4]))
            self._alert.clear()
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def lifecycle_stream(detections: DataFrame, late: str = "5 seconds") -> DataFrame:
    """NEW, SUSTAINED and CLEARED alerts; detection content travels as JSON."""
    body = [c for c in ("kind", "severity", "summary", "reason_codes", "track_ids", "conflict", "conformance") if c in detections.columns]
    timed = detections.select(
        *KEY, "tick_us", F.col("vanish_tick_us").cast("double").alias("vanish_tick_us"), F.to_json(F.struct(*body)).alias("payload"),
        F.timestamp_micros("tick_us").alias("scanned_at"),
    ).withWatermark("scanned_at", late)
    return timed.groupBy(*KEY).transformWithStateInPandas(
        statefulProcessor=AlertProcessor(), outputStructType=_OUT, outputMode="Append", timeMode="EventTime"
    )

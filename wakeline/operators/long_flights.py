"""Track estimation for aircraft with too many reports for one task.

A filter is sequential, but its effect over a stretch of reports can be
summarised before the state at the start of the stretch is known: the stretch
maps an incoming Gaussian to an outgoing one through five small matrices, and
such maps compose associatively (temporal parallelisation of Kalman filters,
Sarkka and Garcia-Fernandez, 2021). A long flight is therefore cut into time
slices that are summarised in parallel, the summaries are chained (one row per
slice), and every slice is then folded in parallel from its true entry state.
The answer is that of the sequential fold up to rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions import kalman as kf
from wakeline.operators import tracking as tr

_KEY = [*tr.KEY, "slice"]
_I2 = np.eye(2)

# A map is (A, b, C, eta, J); the two horizontal axes share A, C and J.
_SUMMARY = (
    "scenario_id string, icao24 string, slice long, absolute boolean, state array<double>, n long, first_us long, last_us long, "
    "segment_us long, ref_lat double, ref_lon double, turn_rate double, innovation double, callsign string, squawk string"
)
_ENTRY = (
    "scenario_id string, icao24 string, slice long, known boolean, bank array<double>, n long, last_us long, segment_us long, "
    "e_lat double, e_lon double, e_heading double, e_turn double, e_innovation double, e_callsign string, e_squawk string, next_us long"
)


def _step(dt, unit, accel, r, has, z):
    """Map of one predict-and-correct; `z` is (components, axes)."""
    f = np.array([[1.0, unit * dt], [0.0, 1.0]])
    g = np.array([0.5 * unit * dt * dt, dt])
    q = np.outer(g, g) * accel * accel
    h = _I2[has]
    s_inv = np.linalg.inv(h @ q @ h.T + np.diag(np.asarray(r)[has]))
    k = q @ h.T @ s_inv
    rest = _I2 - k @ h
    fh = f.T @ h.T @ s_inv
    return rest @ f, k @ z[has], rest @ q, fh @ z[has], fh @ h @ f


def _compose(first, then):
    """Map of `first` followed by `then`; b and eta have one column per axis."""
    a1, b1, c1, n1, j1 = first
    a2, b2, c2, n2, j2 = then
    m = np.linalg.inv(_I2 + c1 @ j2)
    t = np.linalg.inv(_I2 + j2 @ c1)
    return (a2 @ m @ a1, a2 @ m @ (b1 + c1 @ n2) + b2, a2 @ m @ c1 @ a2.T + c2, a1.T @ t @ (n2 - j2 @ b1) + n1, a1.T @ t @ j2 @ a1 + j1)


def _push(mean, cov, element):
    a, b, c, n, j = element
    m = np.linalg.inv(_I2 + cov @ j)
    return a @ m @ (mean + cov @ n) + b, a @ m @ cov @ a.T + c


def _identity(axes: int):
    return _I2.copy(), np.zeros((2, axes)), np.zeros((2, 2)), np.zeros((2, axes)), np.zeros((2, 2))


def _flatten(h, v) -> list[float]:
    return [float(x) for m in (*h, *v) for x in np.asarray(m).ravel()]


def _unflatten(flat: list[float]):
    out, pos = [], 0
    for axes in (2, 1):
        parts = []
        for shape in ((2, 2), (2, axes), (2, 2), (2, axes), (2, 2)):
            size = shape[0] * shape[1]
            parts.append(np.array(flat[pos : pos + size]).reshape(shape))
            pos += size
        out.append(tuple(parts))
    return out


def push(bank: np.ndarray, flat: list[float]) -> np.ndarray:
    """A (1, 12) state through a flattened slice map."""
    h, v = _unflatten(flat)
    b = bank[0]
    mh, ch = _push(
        np.array([[b[kf.E], b[kf.N]], [b[kf.VE], b[kf.VN]]]), np.array([[b[kf.HPP], b[kf.HPV]], [b[kf.HPV], b[kf.HVV]]]), h
    )
    mv, cv = _push(np.array([[b[kf.Z]], [b[kf.W]]]), np.array([[b[kf.ZPP], b[kf.ZPV]], [b[kf.ZPV], b[kf.ZVV]]]), v)
    return np.array([[mh[0, 0], mh[0, 1], mh[1, 0], mh[1, 1], mv[0, 0], mv[1, 0], ch[0, 0], ch[0, 1], ch[1, 1], cv[0, 0], cv[0, 1], cv[1, 1]]])


class _Slice:
    """Running summary of one slice while its rows stream by."""

    def __init__(self, key, frame, prev_us, tuning):
        self.key, self.tuning = key, tuning
        self.frame, self.prev = frame, prev_us
        self.maps = (_identity(2), _identity(1))
        self.flight: tr.Flight | None = None
        self.n, self.first_us, self.texts = 0, None, {"callsign": None, "squawk": None}

    def feed(self, cols: dict) -> None:
        t = cols["t_us"]
        self.first_us = int(t[0]) if self.first_us is None else self.first_us
        if self.flight is None:
            gap = np.diff(t, prepend=self.prev if self.prev is not None else t[0] - int(tr.TERMINATE_AFTER_S * 1e6))
            fresh = np.flatnonzero(gap >= tr.TERMINATE_AFTER_S * 1e6)
            cut = int(fresh[0]) if len(fresh) else len(t)
            self._extend({k: v[:cut] for k, v in cols.items()})
            if cut == len(t):
                return
            cols = {k: v[cut:] for k, v in cols.items()}
        _, self.flight = tr.fold(cols, self.flight, self.tuning)

    def _extend(self, cols: dict) -> None:
        tn = self.tuning
        east, north = tr.project(*self.frame, cols["lat"], cols["lon"]) if len(cols["t_us"]) else ((), ())
        th = np.radians(cols["track_deg"])
        ve, vn = cols["ground_speed_kt"] * np.sin(th), cols["ground_speed_kt"] * np.cos(th)
        for i, t in enumerate(cols["t_us"]):
            if t <= self.prev:
                continue
            dt = (t - self.prev) / 1e6
            has_h = np.array([True, not np.isnan(ve[i])])
            zh = np.array([[east[i], north[i]], [ve[i], vn[i]]])
            zv = np.array([[cols["altitude_baro_ft"][i]], [cols["vertical_rate_fpm"][i]]])
            h = _step(dt, kf.KT, tn.accel_kt_s, (tn.position_nm**2, tn.speed_kt**2), has_h, zh)
            v = _step(dt, kf.FPM, tn.vertical_accel_fpm_s, (tn.altitude_ft**2, tn.vertical_rate_fpm**2), ~np.isnan(zv[:, 0]), zv)
            self.maps = (_compose(self.maps[0], h), _compose(self.maps[1], v))
            self.prev, self.n = int(t), self.n + 1
            for c in self.texts:
                self.texts[c] = cols[c][i] if cols[c][i] is not None else self.texts[c]

    def row(self) -> dict:
        f = self.flight
        base = {**dict(zip(_KEY, self.key)), "first_us": self.first_us}
        if f is not None:
            return {**base, "absolute": True, "state": [float(x) for x in f.bank[0]], "n": f.count, "last_us": f.t_us, "segment_us": f.segment_us,
                    "ref_lat": f.ref_lat, "ref_lon": f.ref_lon, "turn_rate": f.turn_rate, "innovation": f.innovation, "callsign": f.callsign, "squawk": f.squawk}
        return {**base, "absolute": False, "state": _flatten(*self.maps), "n": self.n, "last_us": self.prev, "segment_us": None, "ref_lat": None,
                "ref_lon": None, "turn_rate": 0.0, "innovation": 0.0, **self.texts}


def _slices_of(batch: pa.RecordBatch):
    """Consecutive runs of one (aircraft, slice) inside an Arrow batch."""
    ids = [batch.column(c).to_numpy(zero_copy_only=False) for c in _KEY]
    n = batch.num_rows
    if n == 0:
        return
    change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in ids], axis=0)) + 1
    edges = [0, *change.tolist(), n]
    cols = tr.columns_of(batch)
    for lo, hi in zip(edges[:-1], edges[1:]):
        yield tuple(c[lo] for c in ids), {k: v[lo:hi] for k, v in cols.items()}, batch.slice(lo, 1).to_pylist()[0]


def _summarise(batches: Iterator[pa.RecordBatch], tuning: kf.Tuning, schema: pa.Schema):
    open_: _Slice | None = None
    for batch in batches:
        for key, cols, head in _slices_of(batch):
            if open_ is None or open_.key != key:
                if open_ is not None:
                    yield pa.RecordBatch.from_pylist([open_.row()], schema=schema)
                open_ = _Slice(key, (head["in_lat"], head["in_lon"]), head["prev_us"], tuning)
            open_.feed(cols)
    if open_ is not None:
        yield pa.RecordBatch.from_pylist([open_.row()], schema=schema)


_SUMMARY_ARROW = pa.schema([
    ("scenario_id", pa.string()), ("icao24", pa.string()), ("slice", pa.int64()), ("absolute", pa.bool_()), ("state", pa.list_(pa.float64())),
    ("n", pa.int64()), ("first_us", pa.int64()), ("last_us", pa.int64()), ("segment_us", pa.int64()), ("ref_lat", pa.float64()), ("ref_lon", pa.float64()),
    ("turn_rate", pa.float64()), ("innovation", pa.float64()), ("callsign", pa.string()), ("squawk", pa.string()),
])


def _chain(summaries: pd.DataFrame) -> pd.DataFrame:
    """Entry state of every slice of one aircraft: one summary row per slice, applied in order."""
    rows = summaries.sort_values("slice").to_dict("records")
    out, cur = [], None
    for i, r in enumerate(rows):
        entry = {"scenario_id": r["scenario_id"], "icao24": r["icao24"], "slice": r["slice"], "known": cur is not None,
                 "next_us": int(rows[i + 1]["first_us"]) if i + 1 < len(rows) else None}
        fields = ("bank", "n", "last_us", "segment_us", "e_lat", "e_lon", "e_heading", "e_turn", "e_innovation", "e_callsign", "e_squawk")
        out.append({**entry, **({f: cur[f] for f in fields} if cur else dict.fromkeys(fields))})

        def text(name, old=None):
            return r[name] if isinstance(r[name], str) else old

        if r["absolute"]:
            bank = np.array([list(r["state"])])
            cur = {"n": int(r["n"]), "segment_us": int(r["segment_us"]), "e_lat": r["ref_lat"], "e_lon": r["ref_lon"],
                   "e_callsign": text("callsign"), "e_squawk": text("squawk")}
        else:
            bank = push(np.array([cur["bank"]]), list(r["state"]))
            cur = {**cur, "n": cur["n"] + int(r["n"]), "e_callsign": text("callsign", cur["e_callsign"]), "e_squawk": text("squawk", cur["e_squawk"])}
        cur.update(bank=[float(x) for x in bank[0]], last_us=int(r["last_us"]), e_heading=float(tr._heading(bank)[0]),
                   e_turn=float(r["turn_rate"]), e_innovation=float(r["innovation"]))
    names = [c.split()[0] for c in _ENTRY.split(", ")]
    return pd.DataFrame(out)[names].astype({c: "Int64" for c in ("n", "last_us", "segment_us", "next_us")})


def _fold_slices(batches: Iterator[pa.RecordBatch], as_of_us: int | None, tuning: kf.Tuning, lifecycle: bool):
    key_open, flight, until = None, None, None

    def closing():
        # The slice that knows the last update announces the silence after it.
        if flight is not None and lifecycle and until is not None:
            yield from (tr.to_arrow(r) for r in tr.silence(flight, (until - flight.t_us) / 1e6, tuning))

    for batch in batches:
        for key, cols, head in _slices_of(batch):
            if key != key_open:
                yield from closing()
                key_open, until = key, head["next_us"] if head["next_us"] is not None else as_of_us
                flight, entered_us = None, None
                if head["known"]:
                    flight = tr.Flight(
                        key[:2], np.array([head["bank"]]), head["e_lat"], head["e_lon"], head["last_us"], head["segment_us"], head["n"],
                        head["e_heading"], head["e_turn"], head["e_innovation"], head["e_callsign"], head["e_squawk"],
                    )
                    entered_us = head["last_us"]
            parts, flight = tr.fold(cols, flight, tuning)
            for p in parts:
                silent = p["state"][0] in ("coasting", "terminated")
                if not silent or (lifecycle and p["last_report_us"][0] != entered_us):
                    yield tr.to_arrow(p)
    yield from closing()


def sliced_updates(reports: DataFrame, sizes: DataFrame, rows_per_slice: int, *, as_of_us: int | None, lifecycle: bool, tuning: kf.Tuning) -> DataFrame:
    """Track updates of the aircraft in `sizes` (key, n, first_us, last_us), cut into time slices."""
    span = (F.col("hi_us") - F.col("lo_us") + 1).cast("double")
    parts = F.ceil(F.col("rows") / rows_per_slice)
    plan = sizes.select(*tr.KEY, F.col("n").alias("rows"), F.col("first_us").alias("lo_us"), F.col("last_us").alias("hi_us"))
    r = reports.select(*tr.INPUT_COLUMNS).join(plan, tr.KEY).withColumn(
        "slice", F.floor((F.col("t_us") - F.col("lo_us")) / span * parts).cast("long")
    ).drop("rows", "lo_us", "hi_us")
    # Where flights start inside slices, and from that the frame each slice enters with.
    gap = F.col("t_us") - F.lag("t_us").over(Window.partitionBy(*_KEY).orderBy("t_us", "report_id"))
    pos = F.struct("lat", "lon")
    edges = (
        r.select(*_KEY, "t_us", "report_id", "lat", "lon", (gap >= int(tr.TERMINATE_AFTER_S * 1e6)).alias("restart"))
        .groupBy(*_KEY)
        .agg(
            F.min("t_us").alias("first_us"), F.max("t_us").alias("end_us"), F.min_by(pos, F.struct("t_us", "report_id")).alias("first_pos"),
            F.max_by(F.when(F.col("restart"), pos), F.when(F.col("restart"), F.struct("t_us", "report_id"))).alias("restart_pos"),
        )
    )
    w = Window.partitionBy(*tr.KEY).orderBy("slice")
    edges = edges.withColumn("prev_us", F.lag("end_us").over(w))
    opens = F.col("prev_us").isNull() | (F.col("first_us") - F.col("prev_us") >= int(tr.TERMINATE_AFTER_S * 1e6))
    edges = edges.withColumn("own", F.coalesce("restart_pos", F.when(opens, F.col("first_pos"))))
    frame = F.last("own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    entering = edges.withColumn("frame", frame).select(
        *_KEY, "prev_us", F.bround("frame.lat", 0).alias("in_lat"), F.bround("frame.lon", 0).alias("in_lon")
    )
    order = [*_KEY, "t_us", "report_id"]
    framed = r.join(entering, _KEY).repartition(*_KEY).sortWithinPartitions(*order)
    summaries = framed.mapInArrow(lambda it: _summarise(it, tuning, _SUMMARY_ARROW), _SUMMARY)
    entries = summaries.groupBy(*tr.KEY).applyInPandas(_chain, _ENTRY)
    ready = r.join(entries, _KEY).repartition(*_KEY).sortWithinPartitions(*order)
    return ready.mapInArrow(lambda it: _fold_slices(it, as_of_us, tuning, lifecycle), tr.TRACK_SCHEMA)


"""Per-aircraft state estimation and track lifecycle over keyed reports.

Reports are hash-partitioned and sorted by aircraft and time, then folded with
`mapInArrow`. A partition is consumed as a stream of Arrow batches: all flights
inside a batch advance together as one vectorised bank, and only the last
flight's state is carried to the next batch, so memory is bounded by the batch
and never by the length of a flight.

Lifecycle rules: 3 updates confirm a track; 5 s of silence emits one coasting
row; 30 s of silence emits one terminated row and the next report starts anew.
Deviations from a sweep on a wall clock: transitions fall exactly at +5 s and
+30 s of event time, coasting never moves the filter's own clock (so nothing is
predicted twice), and late or duplicate reports are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions import kalman as kf
from wakeline.functions.geo import EARTH_RADIUS_NM, POLE_COSINE

# Fixed values that results depend on.
CONFIRM_AFTER = 3
COAST_AFTER_S = 5.0
TERMINATE_AFTER_S = 30.0

# Up to this many flights in step are cheaper one by one; any value gives the same result.
FEW_FLIGHTS = 12

KEY = ["scenario_id", "icao24"]

TRACK_SCHEMA = """
scenario_id string, icao24 string, track_id string, callsign string, t_us long, last_report_us long,
segment_us long, state string, lat double, lon double, altitude_ft double, ground_speed_kt double,
track_deg double, vertical_rate_fpm double, turn_rate_deg_s double, position_uncertainty_m double,
velocity_uncertainty_kt double, altitude_uncertainty_ft double, vertical_rate_uncertainty_fpm double,
update_count int, innovation_nm double, squawk string
"""

_MEASURES = ["t_us", "lat", "lon", "altitude_baro_ft", "ground_speed_kt", "track_deg", "vertical_rate_fpm"]
_TEXTS = ["callsign", "squawk"]
INPUT_COLUMNS = KEY + _MEASURES + _TEXTS + ["report_id"]


@dataclass
class Flight:
    """Everything needed to continue one flight with its next report."""

    key: tuple
    bank: np.ndarray  # (1, 12)
    ref_lat: float
    ref_lon: float
    t_us: int
    segment_us: int
    count: int
    heading: float
    turn_rate: float
    innovation: float
    callsign: str | None
    squawk: str | None


def project(ref_lat, ref_lon, lat, lon):
    d_lon = np.mod(lon - ref_lon + 180.0, 360.0) - 180.0
    mean = np.radians((ref_lat + lat) / 2.0)
    return (
        np.radians(d_lon) * np.cos(mean) * EARTH_RADIUS_NM,
        np.radians(lat - ref_lat) * EARTH_RADIUS_NM,
    )


def unproject(ref_lat, ref_lon, east, north):
    lat = ref_lat + np.degrees(north / EARTH_RADIUS_NM)
    c = np.cos(np.radians((ref_lat + lat) / 2.0))
    polar = np.abs(c) < POLE_COSINE
    lon = ref_lon + np.degrees(east / (EARTH_RADIUS_NM * np.where(polar, 1.0, c)))
    return lat, np.where(polar, ref_lon, np.mod(lon + 180.0, 360.0) - 180.0)


def _turn(from_deg, to_deg):
    d = np.mod(to_deg - from_deg + 180.0, 360.0) - 180.0
    return np.where(d <= -180.0, d + 360.0, d)


def _heading(bank):
    h = np.mod(np.degrees(np.arctan2(bank[:, kf.VE], bank[:, kf.VN])), 360.0)
    return np.where(h >= 360.0, 0.0, h)


def _carry_text(values: np.ndarray, first: np.ndarray, seed: str | None) -> np.ndarray:
    """Last non-null value so far within each flight (`first` = index of its first row)."""
    own = np.where(pc.is_valid(pa.array(values, pa.string())).to_numpy(zero_copy_only=False), np.arange(len(values)), -1)
    last = np.maximum.accumulate(own)
    known = last >= first
    out = np.where(known, values[np.maximum(last, 0)], None)
    if seed is not None:
        out[(~known) & (first == 0)] = seed
    return out


def _render(keys, bank, ref_lat, ref_lon, extra) -> dict:
    """Output columns for a bank of states."""
    lat, lon = unproject(ref_lat, ref_lon, bank[:, kf.E], bank[:, kf.N])
    return {
        "scenario_id": keys[0],
        "icao24": keys[1],
        "lat": lat,
        "lon": lon,
        "altitude_ft": np.maximum(0.0, bank[:, kf.Z]),
        "ground_speed_kt": np.hypot(bank[:, kf.VE], bank[:, kf.VN]),
        "track_deg": _heading(bank),
        "vertical_rate_fpm": bank[:, kf.W],
        # RSS over both horizontal axes, in metres; velocity stays per axis.
        "position_uncertainty_m": np.sqrt(np.maximum(0.0, 2.0 * bank[:, kf.HPP])) * 1852.0,
        "velocity_uncertainty_kt": np.sqrt(np.maximum(0.0, bank[:, kf.HVV])),
        "altitude_uncertainty_ft": np.sqrt(np.maximum(0.0, bank[:, kf.ZPP])),
        "vertical_rate_uncertainty_fpm": np.sqrt(np.maximum(0.0, bank[:, kf.ZVV])),
        **extra,
    }


def transitions(keys, bank, ref, info, gap_s, tuning) -> list[dict]:
    """Coasting and terminated rows for flights silent for `gap_s` seconds."""
    out = []
    for after, state in ((COAST_AFTER_S, "coasting"), (TERMINATE_AFTER_S, "terminated")):
        hit = gap_s >= after
        if not hit.any():
            continue
        ahead = bank[hit].copy()
        kf.predict(ahead, np.full(len(ahead), after), tuning)
        sel = {k: v[hit] for k, v in info.items()}
        out.append(
            _render(
                (keys[0][hit], keys[1][hit]), ahead, ref[0][hit], ref[1][hit],
                {
                    **sel,
                    "last_report_us": sel["t_us"],
                    "t_us": sel["t_us"] + int(after * 1e6),
                    "state": np.full(len(ahead), state, dtype=object),
                },
            )
        )
    return out


def _as_flight_arrays(f: Flight):
    info = {
        "t_us": np.array([f.t_us]), "segment_us": np.array([f.segment_us]),
        "update_count": np.array([f.count]), "turn_rate_deg_s": np.array([f.turn_rate]),
        "innovation_nm": np.array([f.innovation]),
        "callsign": np.array([f.callsign], dtype=object), "squawk": np.array([f.squawk], dtype=object),
    }
    keys = (np.array([f.key[0]], dtype=object), np.array([f.key[1]], dtype=object))
    return keys, f.bank, (np.array([f.ref_lat]), np.array([f.ref_lon])), info


def silence(f: Flight, gap_s: float, tuning: kf.Tuning) -> list[dict]:
    """Transitions of a single carried flight."""
    keys, bank, ref, info = _as_flight_arrays(f)
    return transitions(keys, bank, ref, info, np.array([gap_s]), tuning)


def fold(cols: dict, carry: Flight | None, tuning: kf.Tuning) -> tuple[list[dict], Flight | None]:
    """Fold reports sorted by (key, time) into updates; returns rows and the open flight.

    The silence after the last report is unknown here; its transitions belong
    to whoever sees the next report or the end of data.
    """
    sc, ic, t = cols["scenario_id"], cols["icao24"], cols["t_us"]
    n = len(t)
    if n == 0:
        return [], carry
    same = np.zeros(n, dtype=bool)
    same[1:] = (sc[1:] == sc[:-1]) & (ic[1:] == ic[:-1])
    prev_t = np.empty(n, dtype=np.int64)
    prev_t[1:] = t[:-1]
    prev_t[0] = t[0]
    if carry is not None and carry.key == (sc[0], ic[0]):
        same[0], prev_t[0] = True, carry.t_us
    # Sorted input, so a report that is not newer than its predecessor is a
    # duplicate or (against the carried flight) late: it changes nothing.
    late = np.zeros(n, dtype=bool)
    if same[0]:
        late = same & (np.cumsum(~same) == 0) & (t <= carry.t_us)
    keep = ~(same & (t == prev_t)) & ~late
    if not keep.all():
        cols = {k: v[keep] for k, v in cols.items()}
        sc, ic, t, same = cols["scenario_id"], cols["icao24"], cols["t_us"], same[keep]
        n = len(t)
        if n == 0:
            return [], carry
        prev_t = np.empty(n, dtype=np.int64)
        prev_t[1:] = t[:-1]
        same[0] = carry is not None and carry.key == (sc[0], ic[0])
        prev_t[0] = carry.t_us if same[0] else t[0]
    out: list[dict] = []
    dt = np.where(same, (t - prev_t) / 1e6, 0.0)
    starts_new = ~same | (dt >= TERMINATE_AFTER_S)
    if carry is not None and same[0]:
        out += silence(carry, dt[0], tuning)
    continued = not starts_new[0]
    begin = np.flatnonzero(starts_new)
    if continued:
        begin = np.concatenate([[0], begin])
    length = np.diff(np.append(begin, n))
    seg_of = np.repeat(np.arange(len(begin)), length)
    first = begin[seg_of]

    ref_lat, ref_lon = np.rint(cols["lat"][begin]), np.rint(cols["lon"][begin])
    if continued:
        ref_lat[0], ref_lon[0] = carry.ref_lat, carry.ref_lon
    row_ref = ref_lat[seg_of], ref_lon[seg_of]
    east, north = project(*row_ref, cols["lat"], cols["lon"])
    theta = np.radians(cols["track_deg"])
    meas = kf.Measured(
        east, north, cols["ground_speed_kt"] * np.sin(theta), cols["ground_speed_kt"] * np.cos(theta),
        cols["altitude_baro_ft"], cols["vertical_rate_fpm"],
    )
    # A speed without a heading (or the reverse) still initialises as a speed of
    # zero heading, but later updates need both.
    start_meas = meas.take(begin)
    speed0 = np.nan_to_num(cols["ground_speed_kt"][begin], nan=0.0)
    theta0 = np.nan_to_num(theta[begin], nan=0.0)
    start_meas.v_east, start_meas.v_north = speed0 * np.sin(theta0), speed0 * np.cos(theta0)

    # Longest flights first: the still-active ones are always a prefix.
    order = np.argsort(-length, kind="stable")
    bank = kf.initial(start_meas, tuning)[order]
    states = np.empty((n, kf.WIDTH))
    surprise = np.zeros(n)
    sizes, heads = length[order], begin[order]
    skip = int(np.flatnonzero(order == 0)[0]) if continued else -1
    if continued:
        one = carry.bank.copy()
        kf.predict(one, dt[:1], tuning)
        surprise[0] = kf.correct(one, meas.take(slice(0, 1)), tuning)[0]
        bank[skip] = one[0]
    states[heads] = bank
    active = len(sizes)
    for j in range(1, int(sizes[0])):
        while sizes[active - 1] <= j:
            active -= 1
        if active <= FEW_FLIGHTS:
            for k in range(active):
                run = slice(heads[k] + j, heads[k] + sizes[k])
                states[run], surprise[run] = kf.follow(bank[k], dt[run], meas.take(run), tuning)
            break
        idx = heads[:active] + j
        live = bank[:active]
        kf.predict(live, dt[idx], tuning)
        surprise[idx] = kf.correct(live, meas.take(idx), tuning)
        states[idx] = live

    heading = _heading(states)
    prev_heading = np.empty(n)
    prev_heading[1:] = heading[:-1]
    prev_heading[0] = carry.heading if continued else heading[0]
    fresh = starts_new
    turn = np.where(fresh, 0.0, _turn(prev_heading, heading) / np.where(dt > 0.0, dt, 1.0))
    count = np.arange(n) - first + 1
    segment = t[first].copy()
    if continued:
        count[seg_of == 0] += carry.count
        segment[seg_of == 0] = carry.segment_us
    info = {
        "t_us": t,
        "segment_us": segment,
        "update_count": count,
        "turn_rate_deg_s": turn,
        "innovation_nm": surprise,
        "callsign": _carry_text(cols["callsign"], first, carry.callsign if continued else None),
        "squawk": _carry_text(cols["squawk"], first, carry.squawk if continued else None),
    }
    out.append(
        _render(
            (sc, ic), states, *row_ref,
            {
                **info,
                "last_report_us": t,
                "state": np.where(count >= CONFIRM_AFTER, "confirmed", "initiating").astype(object),
            },
        )
    )
    # Silences that end inside this batch.
    gap = np.zeros(n)
    gap[:-1] = np.where(same[1:], dt[1:], 0.0)
    out += transitions((sc, ic), states, row_ref, info, gap, tuning)
    last = n - 1
    # Other aircraft whose reports end inside this batch stay silent to the end
    # of data; only the caller knows when that is.
    ends = np.flatnonzero(~same[1:])
    flight = Flight(
        (sc[last], ic[last]), states[last : last + 1].copy(), float(row_ref[0][last]), float(row_ref[1][last]),
        int(t[last]), int(segment[last]), int(count[last]), float(heading[last]), float(turn[last]),
        float(surprise[last]), info["callsign"][last], info["squawk"][last],
    )
    if len(ends):
        idx = ends
        out.append(
            {"__open__": True, "keys": (sc[idx], ic[idx]), "bank": states[idx], "ref": (row_ref[0][idx], row_ref[1][idx]),
             "info": {k: v[idx] for k, v in info.items()}}
        )
    if carry is not None and not same[0]:
        out.append({"__carry_closed__": carry})
    return out, flight


_ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
_FIELDS = [tuple(f.split()) for f in TRACK_SCHEMA.replace("\n", " ").strip().split(",")]
ARROW_SCHEMA = pa.schema([(n, _ARROW[t]) for n, t in _FIELDS])


def to_arrow(rows: dict) -> pa.RecordBatch:
    rows = dict(rows)
    rows["track_id"] = np.array(["trk-" + x for x in rows["icao24"]], dtype=object)
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[f.name], type=f.type) for f in ARROW_SCHEMA], schema=ARROW_SCHEMA
    )


def columns_of(batch: pa.RecordBatch) -> dict:
    cols = {}
    for name in KEY + _TEXTS:
        cols[name] = batch.column(name).to_numpy(zero_copy_only=False)
    cols["t_us"] = batch.column("t_us").to_numpy(zero_copy_only=False)
    for name in _MEASURES[1:]:
        cols[name] = batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)
    return cols


def _fold_partition(batches: Iterator[pa.RecordBatch], as_of_us: int | None, tuning: kf.Tuning, lifecycle: bool):
    carry: Flight | None = None

    def emit(parts):
        for p in parts:
            if "__open__" in p:
                if lifecycle and as_of_us is not None:
                    gap = (as_of_us - p["info"]["t_us"]) / 1e6
                    yield from (to_arrow(r) for r in transitions(p["keys"], p["bank"], p["ref"], p["info"], gap, tuning))
            elif "__carry_closed__" in p:
                f = p["__carry_closed__"]
                if lifecycle and as_of_us is not None:
                    yield from (to_arrow(r) for r in silence(f, (as_of_us - f.t_us) / 1e6, tuning))
            elif lifecycle or p["state"][0] in ("initiating", "confirmed"):
                yield to_arrow(p)

    for batch in batches:
        parts, carry = fold(columns_of(batch), carry, tuning)
        yield from emit(parts)
    if carry is not None:
        yield from emit([{"__carry_closed__": carry}])


ROWS_PER_TASK = 1_000_000


def track_updates(
    reports: DataFrame,
    *,
    as_of_us: int | None = None,
    lifecycle: bool = True,
    tuning: kf.Tuning | None = None,
    rows_per_task: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Track updates for every report, plus coasting and terminated rows.

    `as_of_us` is the instant up to which silence after the last report is
    judged; `lifecycle=False` leaves out the silence-driven rows, which is what
    an evaluation replay sees. Aircraft with more than `rows_per_task` reports
    are cut into time slices that are estimated in parallel; None never cuts.
    """
    t = tuning or kf.Tuning()
    if rows_per_task is None:
        return _whole(reports, as_of_us, lifecycle, t)
    sizes = reports.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))
    long = sizes.where(F.col("n") > rows_per_task)
    if long.isEmpty():
        return _whole(reports, as_of_us, lifecycle, t)
    from wakeline.operators.long_flights import sliced_updates
    from wakeline.session import cut_lineage

    long = cut_lineage(long)
    rest = _whole(reports.join(long.select(*KEY), KEY, "left_anti"), as_of_us, lifecycle, t)
    return rest.unionByName(
        sliced_updates(reports, long, rows_per_task, as_of_us=as_of_us, lifecycle=lifecycle, tuning=t)
    )


def _whole(reports: DataFrame, as_of_us: int | None, lifecycle: bool, tuning: kf.Tuning) -> DataFrame:
    ordered = (
        reports.select(*INPUT_COLUMNS)
        .repartition(*KEY)
        .sortWithinPartitions(*KEY, "t_us", "report_id")
    )
    return ordered.mapInArrow(lambda it: _fold_partition(it, as_of_us, tuning, lifecycle), TRACK_SCHEMA)

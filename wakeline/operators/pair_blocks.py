"""Folds over all pairs of a sky, without a row for each pair and instant.

Scorecards and tallies need of a pair only its first conflict, its closest
approach or a count. Paths are dealt to blocks by a hash of their id; a task has
two blocks through a slice of time, meets them as matrices instant by instant,
and gives what it folded. Every path is sent once for each block of its
scenario, so rows moved are paths x blocks, and a task's memory is two blocks of
`BLOCK` paths through one slice, however dense the sky or long the time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions import geo, labels
from wakeline.session import cut_lineage

# Any values give the same result.
BLOCK = 1024
SLICE_S = 512
_AT_ONCE = 24
_TESTED = 16384
_JUDGED = 16384
_PAIRS = 256
_ROWS = 65536

GROUP = ["scenario_id", "slice", "low", "high"]
_STATE = ["east_nm", "north_nm", "v_east_kt", "v_north_kt", "altitude_ft", "vertical_rate_fpm"]
_PARALLEL = 1e-12
_NEVER = np.iinfo(np.int64).max
_NONE = np.iinfo(np.int64).min // 2


def paths(rows: DataFrame, ident: str, at: str, columns: list[str], slice_size: float, size: int = BLOCK) -> DataFrame:
    """One row a path and slice of time, its instants and columns as arrays in order of time, with its block."""
    step = F.struct(at, *columns)
    flown = rows.groupBy("scenario_id", F.floor(F.col(at) / slice_size).alias("slice"), F.col(ident).alias("id")).agg(F.sort_array(F.collect_list(step)).alias("p"))
    flown = cut_lineage(flown.select("scenario_id", "slice", "id", *[F.col(f"p.{c}").alias(c) for c in (at, *columns)]))
    # A small sky has a few smaller blocks, so that its groups are more than one task's work.
    blocks = F.greatest(F.ceil(F.count("*") / size), F.least(F.ceil(F.count("*") * 4 / size), F.lit(4)))
    many = flown.select("scenario_id", "id").distinct().groupBy("scenario_id").agg(blocks.cast("int").alias("blocks"))
    return flown.join(many, "scenario_id").withColumn("block", block_of("id"))


def block_of(ident: str) -> Column:
    return F.pmod(F.xxhash64(ident), F.col("blocks")).cast("int")


def _width(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def beside_each_block(dealt: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Paths in the groups of their block with every block, itself included."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = dealt.select("*", other).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("blocks", "other")
    # Groups are few and heavy: small partitions of them must not be merged.
    return rows.repartition(_width(dealt), *group)


def _flat(table: pa.Table, name: str) -> np.ndarray:
    """All elements of a column of arrays, in order of rows."""
    return pc.list_flatten(table.column(name)).to_numpy()


class _Sky:
    """The paths of a group, instant by instant."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("id").combine_chunks()
        low, high, block = (table.column(c).to_numpy() for c in ("low", "high", "block"))
        self.same = bool(low[0] == high[0])
        self.left = block == low
        lengths = pc.list_value_length(table.column("tick_us")).to_numpy()
        self.tick = _flat(table, "tick_us")
        self.path = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self.state = np.column_stack([_flat(table, c) for c in _STATE])

    def instants(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each tick with the rows of both blocks; a block beside itself has all its rows on both sides."""
        order = np.argsort(self.tick, kind="stable")
        ticks, starts = np.unique(self.tick[order], return_index=True)
        for tick, rows in zip(ticks, np.split(order, starts[1:])):
            left = self.left[self.path[rows]]
            yield int(tick), rows[left], rows if self.same else rows[~left]

    def near(self, spans: list[float], horizontal_nm: float, vertical_ft: float, seen: np.ndarray | None = None,
             named: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(tick, rows, rows) of pairs that may conflict within one of `spans`: all that do, and few others."""
        for tick, left, right in self.instants():
            if not len(left) or not len(right):
                continue
            look = _Look(self.state[left], self.state[right], spans, horizontal_nm, vertical_ft)
            step = _AT_ONCE if named is not None else max(1, _TESTED // len(right))
            found, n = [], 0
            for at in range(0, len(left), step):
                own = np.arange(at, min(at + step, len(left)))
                if named is None:
                    # Rows of a tick are in order of paths: a block beside itself needs only the later ones.
                    meets = [(slice(at, at + step), slice(at if self.same else 0, None))]
                else:
                    known, new = named[self.path[left[own]]], np.flatnonzero(~named[self.path[right]])
                    meets = [(own[~known], slice(None)), (own[known], new)]
                for rows, others in meets:
                    of = right[others]
                    i, j = np.divmod(np.flatnonzero(look.near(rows, others)).astype(np.int32), np.int32(max(1, len(of))))
                    i, j = left[rows][i], of[j]
                    p, q = self.path[i], self.path[j]
                    if seen is not None:
                        kept = ~seen[p, q]
                    if self.same:
                        apart = p < q if named is None else p != q
                        kept = apart if seen is None else kept & apart
                    if self.same or seen is not None:
                        i, j = i[kept], j[kept]
                    found.append((i, j))
                    n += len(i)
                if n > _JUDGED or named is not None:
                    yield tick, *(np.concatenate(c) for c in zip(*found))
                    found, n = [], 0
            if n:
                yield tick, *(np.concatenate(c) for c in zip(*found))

    def conflicts(self, spans: list[float], horizontal_nm: float, vertical_ft: float, seen: np.ndarray | None = None,
                  named: np.ndarray | None = None) -> Iterator[tuple]:
        """(tick, lookahead number, row, row, time, horizontal, vertical) of conflicts, each once.

        `seen` marks pairs of paths to leave out. `named` marks paths that need
        no more conflicts among themselves, and may grow meanwhile; others are then told once or twice.
        """
        longest = max(spans)
        for tick, i, j in self.near(spans, horizontal_nm, vertical_ft, seen, named):
            apart = _Apart(self.state[j] - self.state[i])
            t, h, v = apart.at(apart.closest(longest))
            hit = np.flatnonzero((h < horizontal_nm) & (v < vertical_ft))
            whole = (i[hit], j[hit], t[hit], h[hit], v[hit])
            for k, span in enumerate(spans):
                if span == longest:
                    yield tick, k, *whole
                    continue
                # A shorter look differs only for pairs that come closest after its end.
                late = np.flatnonzero(apart.raw > span)
                t, h, v = apart.at(np.full(len(late), span), late)
                ends = (h < horizontal_nm) & (v < vertical_ft)
                early = whole[2] <= span
                own = (i[late], j[late], t, h, v)
                yield tick, k, *(np.concatenate([x[early], y[ends]]) for x, y in zip(whole, own))


class _Apart:
    """Pairs by the difference of their states: when and how they come closest, in double precision."""

    def __init__(self, difference: np.ndarray):
        self.re, self.rn, ve, vn, self.rz, vz = np.ascontiguousarray(difference.T)
        self.rve, self.rvn, self.rvz = ve / 3600.0, vn / 3600.0, vz / 60.0
        speed2 = self.rve * self.rve + self.rvn * self.rvn
        moving = speed2 >= _PARALLEL
        # Matched speeds never change the separation: the closest approach is now.
        self.raw = np.where(moving, -(self.re * self.rve + self.rn * self.rvn) / np.where(moving, speed2, 1.0), 0.0)

    def closest(self, span: float) -> np.ndarray:
        return np.maximum(0.0, np.minimum(span, self.raw))

    def at(self, t: np.ndarray, of: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Time, horizontal and vertical distance at `t`."""
        h = np.hypot(self.re[of] + self.rve[of] * t, self.rn[of] + self.rvn[of] * t)
        return t, h, np.abs(self.rz[of] + self.rvz[of] * t)


class _Look:
    """Two sides of a tick, to be met in single precision.

    Squares and products of differences are products of two matrices, and off
    by less than 3e-6 of the square of the longest way to a place within the
    look (rounding errors of 6e-8 of at most 50 such terms). Squares of speeds get
    more than their error added, so that none is zero. The time of closest
    approach is ill defined only for slow pairs, which move little, but may
    climb meanwhile: their vertical allowance grows as they are slower. Below
    the longest look, heights count from the end of the shortest on.
    """

    def __init__(self, own: np.ndarray, other: np.ndarray, spans: list[float], horizontal_nm: float, vertical_ft: float):
        (p, u), (q, w) = (((s[:, :2], s[:, 2:4] / 3600.0)) for s in (own, other))
        far, fast = (max(float(np.sqrt(np.nanmax((x * x).sum(axis=1), initial=1e-12))) for x in xs) for xs in ((p, q), (u, w)))
        span = max(spans)
        way = far + span * fast
        self.span, self.shortest = np.float32(span), np.float32(min(spans)) if len(spans) > 1 else None
        self.reach2, self.height = np.float32(horizontal_nm**2 + 2e-5 * way * way), np.float32(vertical_ft + 1.0)
        self.late = np.float32(1e-5 * fast * way)
        one, unit = np.ones((len(own), 1)), np.ones((len(other), 1))

        def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (a * b).sum(axis=1)[:, None]

        def sides(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            return np.hstack(left).astype(np.float32), np.ascontiguousarray(np.hstack(right).astype(np.float32).T)

        self.closing = sides([p, u, -dot(p, u), one], [w, q, unit, -dot(q, w)])
        self.speed2 = sides([u, dot(u, u), one], [-2.0 * w, unit, dot(w, w) + 4e-6 * fast * fast])
        self.distance2 = sides([p, dot(p, p), one], [-2.0 * q, unit, dot(q, q)])
        scale = np.array([1.0, 1.0 / 60.0])
        self.climb = tuple(np.ascontiguousarray((s[:, 4:] * scale).astype(np.float32).T) for s in (own, other))

    def near(self, rows: np.ndarray | slice, others: np.ndarray | slice) -> np.ndarray:
        """Which of some rows and others may conflict."""
        closing, speed2, d = (a[rows] @ b[:, others] for a, b in (self.closing, self.speed2, self.distance2))
        t = closing / speed2
        # Between 0 and the span; minimum and maximum are slower.
        work = t - self.span
        np.abs(work, out=work)
        np.abs(t, out=t)
        t -= work
        t += self.span
        t *= np.float32(0.5)
        # distance2 + t * (t * speed2 - 2 * closing)
        np.multiply(t, speed2, out=work)
        work -= closing
        work -= closing
        work *= t
        d += work
        (z, vz), (oz, ovz) = self.climb
        climb = np.subtract(ovz[None, others], vz[rows, None])
        np.multiply(climb, t, out=work)
        work += np.subtract(oz[None, others], z[rows, None])
        np.abs(work, out=work)
        np.abs(climb, out=climb)
        if self.shortest is not None:
            t -= self.shortest
            np.maximum(t, np.float32(0.0), out=t)
            t *= climb
            work -= t
        climb *= self.late
        climb /= speed2
        work -= climb
        return (d < self.reach2) & (work < self.height)


def _framed(framed: DataFrame, slice_s: float, size: int) -> DataFrame:
    return beside_each_block(paths(framed, "track_id", "tick_us", _STATE, slice_s * 1e6, size))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Sorted batches as one table for each group in a slice of time."""
    held, key = [], None
    for batch in batches:
        names = [batch.column(c) for c in ("scenario_id", "low", "high", "slice")]
        changes = np.zeros(batch.num_rows, bool)
        for c in names:
            changes[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        starts = [0, *np.flatnonzero(changes).tolist(), batch.num_rows] if batch.num_rows else []
        for at, end in zip(starts, starts[1:]):
            own = tuple(c[at].as_py() for c in names)
            if held and own != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = own
            held.append(batch.slice(at, end - at))
    if held:
        yield key, pa.Table.from_batches(held)


class _Told(_Sky):
    """Paths that tell conflicts as rows of a table."""

    COLUMNS = (
        ("scenario_id", pa.string()), ("tick_us", pa.int64()), ("first_track_id", pa.string()), ("second_track_id", pa.string()),
        ("first_callsign", pa.string()), ("second_callsign", pa.string()), ("vanish_tick_us", pa.int64()), ("time_to_cpa_s", pa.float64()),
        ("min_horizontal_nm", pa.float64()), ("min_vertical_ft", pa.float64()), ("current_horizontal_nm", pa.float64()),
        ("current_vertical_ft", pa.float64()),
    )
    KINDS = {pa.string(): "string", pa.int64(): "long", pa.float64(): "double"}

    def __init__(self, table: pa.Table):
        super().__init__(table)
        self.scenario = table.column("scenario_id")[0]
        self.callsign = pc.list_flatten(table.column("callsign")).combine_chunks()
        self.vanish = pc.fill_null(pc.list_flatten(table.column("vanish_tick_us")), _NEVER).to_numpy()
        self.rank = np.empty(len(self.ids), int)
        self.rank[pc.sort_indices(self.ids).to_numpy()] = np.arange(len(self.ids))

    def columns(self, i: np.ndarray, j: np.ndarray, span: float | np.ndarray) -> list[pa.Array]:
        """COLUMNS of the conflicts between rows, pairs in the order of their ids."""
        swap = self.rank[self.path[i]] > self.rank[self.path[j]]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        apart = _Apart(self.state[j] - self.state[i])
        t, h, v = apart.at(apart.closest(span))
        vanish = np.minimum(self.vanish[i], self.vanish[j])
        names = [of.take(pa.array(rows)) for of, rows in ((self.ids, self.path[i]), (self.ids, self.path[j]), (self.callsign, i), (self.callsign, j))]
        numbers = [pa.array(c) for c in (t, h, v, np.hypot(apart.re, apart.rn), np.abs(apart.rz))]
        return [pa.repeat(self.scenario, len(i)), pa.array(self.tick[i]), *names, pa.array(vanish, mask=vanish == _NEVER), *numbers]


def _schema(columns: tuple) -> str:
    return ", ".join(f"{n} {_Told.KINDS[t]}" for n, t in columns)


def _told(framed: DataFrame, slice_s: float, size: int) -> DataFrame:
    """Paths in the groups of their blocks, all slices of a group in one partition, in order of time."""
    dealt = paths(framed, "track_id", "tick_us", [*_STATE, "vanish_tick_us", "callsign"], slice_s * 1e6, size)
    return beside_each_block(dealt, ["scenario_id", "low", "high"]).sortWithinPartitions("scenario_id", "low", "high", "slice")


def all_conflicts(framed: DataFrame, spans: list[float], horizontal_nm: float, vertical_ft: float, *, longest_only: bool = False,
                  size: int = BLOCK, slice_s: float = SLICE_S) -> DataFrame:
    """Every conflict at every lookahead, streamed out of the blocks: nothing of a pair is shuffled or sorted.

    With `longest_only`, a pair at an instant is told once, at the longest lookahead that finds it.
    """
    names = (*_Told.COLUMNS, ("lookahead_s", pa.float64()))

    def told(sky: _Told, found: list) -> pa.RecordBatch:
        i, j, span = (np.concatenate(c) for c in zip(*found))
        return pa.RecordBatch.from_arrays([*sky.columns(i, j, span), pa.array(span)], names=[n for n, _ in names])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _slices(batches):
            sky, found, n = _Told(table), [], 0
            for i, j, span in _longest(sky, spans, horizontal_nm, vertical_ft) if longest_only else _each(sky, spans, horizontal_nm, vertical_ft):
                found.append((i, j, span))
                n += len(i)
                if n >= _ROWS:
                    yield told(sky, found)
                    found, n = [], 0
            if n:
                yield told(sky, found)

    return _told(framed, slice_s, size).mapInArrow(fold, _schema(names))


def _each(sky: _Sky, spans: list[float], horizontal_nm: float, vertical_ft: float) -> Iterator[tuple]:
    for _, k, i, j, *_ in sky.conflicts(spans, horizontal_nm, vertical_ft):
        yield i, j, np.full(len(i), spans[k])


def _longest(sky: _Sky, spans: list[float], horizontal_nm: float, vertical_ft: float) -> Iterator[tuple]:
    """Conflicts at the longest lookahead that has them: all lookaheads of some pairs come one after another."""
    falling, taken = sorted(spans, reverse=True), None
    for _, k, i, j, *_ in sky.conflicts(falling, horizontal_nm, vertical_ft):
        own = i.astype(np.int64) * len(sky.path) + j
        new = np.ones(len(i), bool) if k == 0 else ~np.isin(own, taken)
        taken = own if k == 0 else np.concatenate([taken, own[new]])
        yield i[new], j[new], np.full(int(new.sum()), falling[k])


_SPELL = (("state", pa.string()), ("raised_us", pa.int64()), ("updated_us", pa.int64()), ("detections", pa.int64()))
_RUNNING = (("left", pa.string()), ("right", pa.string()), ("last_us", pa.int64()), ("gone_us", pa.int64()), ("published_us", pa.int64()))


class _Spells:
    """The alerts of a group's pairs through one slice, as matrices of its left and right paths."""

    def __init__(self, sky: _Told, span: float, tick_us: int, clear_after: int, every_us: int, states: tuple[str, ...], carried: pa.Table | None, at_end: bool):
        self.sky, self.span, self.states, self.at_end = sky, span, states, at_end
        self.clear_us, self.limit_us, self.every_us = clear_after * tick_us, (clear_after + 1) * tick_us, every_us
        sides = (np.arange(len(sky.ids)),) * 2 if sky.same else (np.flatnonzero(sky.left), np.flatnonzero(~sky.left))
        self.sides, self.width = sides, len(sides[1])
        self.place = np.empty((2, len(sky.ids)), np.int64)
        for place, paths_ in zip(self.place, sides):
            place[paths_] = np.arange(len(paths_))
        self.ticks, at = np.unique(sky.tick, return_inverse=True)
        self.row = np.full((len(sky.ids), len(self.ticks)), -1, np.int32)
        self.row[sky.path, at] = np.arange(len(sky.path))
        cells = len(sides[0]) * self.width
        self.raised, self.published = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        self.last, self.gone = np.full(cells, _NONE), np.full(cells, _NEVER)
        self.seen = np.zeros(cells, np.int32)
        self.found, self.pending = [], 0
        self.before, self.aside, self.key = None, carried, np.zeros(0, np.int64)
        if carried is not None and carried.num_rows:
            a, b = (pc.index_in(carried.column(c).combine_chunks(), value_set=sky.ids.take(pa.array(s))) for c, s in zip(("left", "right"), sides))
            here = pc.and_(pc.is_valid(a), pc.is_valid(b))
            self.aside, self.before = carried.filter(pc.invert(here)), carried.filter(here)
            self.key = a.filter(here).to_numpy(zero_copy_only=False).astype(np.int64) * self.width + b.filter(here).to_numpy(zero_copy_only=False)
            for of, name in ((self.last, "last_us"), (self.gone, "gone_us"), (self.raised, "raised_us"), (self.published, "published_us"), (self.seen, "detections")):
                of[self.key] = self.before.column(name).to_numpy()

    def take(self, tick: int, i: np.ndarray, j: np.ndarray) -> None:
        """Conflicts of a tick between rows of the left and of the right, each pair once."""
        sky = self.sky
        of = self.place[0][sky.path[i]] * self.width + self.place[1][sky.path[j]]
        last, gone = self.last[of], self.gone[of]
        opens = (tick - last >= self.limit_us) | (gone < tick)
        if not self.at_end:
            ended = of[opens & (last > _NONE)]
            if len(ended):
                self.end(ended)
        self.seen[of] += 1
        self.seen[of[opens]] = 1
        new, stays = np.flatnonzero(opens), np.flatnonzero(~opens)
        beats = stays[tick - self.published[of[stays]] >= self.every_us]
        self.raised[of[new]] = tick
        for state, rows in (("new", new), ("sustained", beats)):
            self.published[of[rows]] = tick
            if not self.at_end:
                self.tell(state, i[rows], j[rows], self.raised[of[rows]], np.full(len(rows), tick), self.seen[of[rows]])
        self.last[of] = tick
        vanish = np.minimum(sky.vanish[i], sky.vanish[j])
        other = np.flatnonzero(vanish != gone)
        self.gone[of[other]] = vanish[other]

    def tell(self, state: str, i: np.ndarray, j: np.ndarray, raised: np.ndarray, updated: np.ndarray, seen: np.ndarray) -> None:
        if len(i) and state in self.states:
            self.found.append((np.full(len(i), self.states.index(state), np.int8), i, j, raised, updated, seen))
            self.pending += len(i)

    def cleared(self, of: np.ndarray) -> np.ndarray:
        return np.minimum(self.last[of] + self.clear_us, self.gone[of])

    def end(self, of: np.ndarray) -> None:
        """Tell that spells are cleared, by their last detections."""
        here = self.last[of] >= self.ticks[0]
        i, j = self.rows(of[here], self.last)
        self.tell("cleared", i, j, self.raised[of[here]], self.cleared(of[here]), self.seen[of[here]])
        if not here.all():
            self.found_before(of[~here])

    def rows(self, of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.ticks, at[of])
        return self.row[self.sides[0][of // self.width], k], self.row[self.sides[1][of % self.width], k]

    def found_before(self, of: np.ndarray) -> None:
        if "cleared" in self.states:
            self.found.append(self.carried_rows(of).select([n for n, _ in _ALERT]))
            self.pending += len(of)

    def carried_rows(self, of: np.ndarray) -> pa.Table:
        order = np.argsort(self.key)
        return self.before.take(pa.array(order[np.searchsorted(self.key[order], of)]))

    def flush(self) -> Iterator[pa.RecordBatch]:
        """What was told since."""
        rows = [f for f in self.found if isinstance(f, tuple)]
        tables = [f for f in self.found if not isinstance(f, tuple)]
        if rows:
            state, i, j, raised, updated, seen = (np.concatenate(c) for c in zip(*rows))
            tables.append(self.table(i, j, pa.array(self.states).take(pa.array(state)), raised, updated, seen))
        self.found, self.pending = [], 0
        for t in tables:
            yield from t.to_batches(max_chunksize=_ROWS)

    def table(self, i: np.ndarray, j: np.ndarray, state: pa.Array, raised: np.ndarray, updated: np.ndarray, seen: np.ndarray) -> pa.Table:
        numbers = [pa.array(c.astype(np.int64)) for c in (raised, updated, seen)]
        return pa.table([*self.sky.columns(i, j, self.span), state, *numbers], names=[n for n, _ in _ALERT])

    def running(self, since_us: int) -> pa.Table | None:
        """Spells with a detection since then, as rows to be carried on; the others are told as cleared."""
        known = np.flatnonzero(self.seen)
        runs = self.last[known] >= since_us
        if not self.at_end:
            self.end(known[~runs])
        known = known[runs]
        # A spell is told by its last detection when it is cleared, and by its last publication while it runs.
        at = self.published if self.at_end else self.last
        here = at[known] >= self.ticks[0]
        own, old = known[here], known[~here]
        state = "new" if not len(own) else np.where(self.published[own] == self.raised[own], "new", "sustained") if self.at_end else np.full(len(own), "cleared")
        out = [] if self.aside is None else [self._kept_aside(since_us)]
        for of, rows in ((own, self.table(*self.rows(own, at), pa.array(state), self.raised[own], self.published[own] if self.at_end else self.cleared(own), self.seen[own]) if len(own) else None),
                         (old, self.carried_rows(old).select([n for n, _ in _ALERT]) if len(old) else None)):
            if rows is not None:
                rows = rows.set_column(rows.column_names.index("detections"), "detections", pa.array(self.seen[of].astype(np.int64)))
                ids = [self.sky.ids.take(pa.array(s[x])) for s, x in zip(self.sides, (of // self.width, of % self.width))]
                for name, c in zip([n for n, _ in _RUNNING], (*ids, pa.array(self.last[of]), pa.array(self.gone[of]), pa.array(self.published[of]))):
                    rows = rows.append_column(name, c)
                out.append(rows)
        return pa.concat_tables(out) if out else None

    def _kept_aside(self, since_us: int) -> pa.Table:
        kept = pc.greater_equal(self.aside.column("last_us"), since_us)
        if not self.at_end and "cleared" in self.states:
            self.found.append(self.aside.filter(pc.invert(kept)).select([n for n, _ in _ALERT]))
        return self.aside.filter(kept)


_ALERT = (*_Told.COLUMNS, *_SPELL)


def alert_spells(framed: DataFrame, span: float, horizontal_nm: float, vertical_ft: float, *, tick_us: int, clear_after: int, every_us: int,
                 states: tuple[str, ...] = ("new", "sustained", "cleared"), running_at_us: int | None = None,
                 size: int = BLOCK, slice_s: float = SLICE_S) -> DataFrame:
    """The alerts of conflicts, without a row for a conflict that is not published.

    One row for each publication in one of the `states`: the conflict that it
    tells of, when the alert was raised, and how many detections the spell has
    had until then. A cleared spell is told by its last detection, also where
    the time of clearing lies beyond the data. A group's pairs are followed
    through its slices in order; only running spells go from one to the next.
    With `running_at_us`, the last publication of each alert that is not
    cleared by then, new or sustained, and nothing else; `framed` ends there.
    """
    at_end = running_at_us is not None
    told = ("new", "sustained") if at_end else states
    slice_us = int(slice_s * 1e6)

    def rest(carried: pa.Table | None) -> Iterator[pa.RecordBatch]:
        """Alerts that run when a group's data end."""
        if carried is not None and carried.num_rows:
            if at_end:
                clear = pc.min_element_wise(pc.add(carried.column("last_us"), clear_after * tick_us), carried.column("gone_us"))
                carried = carried.filter(pc.greater(clear, running_at_us))
            if at_end or "cleared" in told:
                yield from carried.select([n for n, _ in _ALERT]).to_batches(max_chunksize=_ROWS)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, carried = None, None
        for (*own, number), table in _slices(batches):
            if own != group:
                yield from rest(carried)
                group, carried = own, None
            sky = _Told(table)
            spells = _Spells(sky, span, tick_us, clear_after, every_us, told, carried, at_end)
            for tick, _, i, j, *_ in sky.conflicts([span], horizontal_nm, vertical_ft):
                spells.take(tick, i, j)
                if spells.pending >= _ROWS:
                    yield from spells.flush()
            # Where slices are shorter than a gap may be, a spell runs on through one without a detection.
            end = (number + 1) * slice_us if not at_end else min((number + 1) * slice_us, running_at_us)
            carried = spells.running(end - (clear_after + 1) * tick_us)
            yield from spells.flush()
        yield from rest(carried)

    return _told(framed, slice_s, size).mapInArrow(fold, _schema(_ALERT))


def first_conflicts(framed: DataFrame, spans: list[float], horizontal_nm: float, vertical_ft: float, *, size: int = BLOCK, slice_s: float = SLICE_S) -> DataFrame:
    """The first conflict of each pair in each slice of time and at each lookahead, with its closest approach.

    `framed` has the tracks at each tick in that tick's frame (`picture.in_shared_frame`).
    """
    schema = ("scenario_id string, tick_us long, first_track_id string, second_track_id string, time_to_cpa_s double,"
              " min_horizontal_nm double, min_vertical_ft double, lookahead_s double")

    def fold(table: pa.Table) -> pa.Table:
        sky = _Sky(table)
        seen = [np.zeros((len(sky.ids),) * 2, bool) for _ in spans]
        out = []
        for tick, k, i, j, *found in sky.conflicts(spans, horizontal_nm, vertical_ft, seen[0] if len(spans) == 1 else None):
            a, b = sky.path[i], sky.path[j]
            new = ~seen[k][a, b]
            a, b = a[new], b[new]
            seen[k][a, b] = True
            out.append([np.full(len(a), tick), a, b, *[f[new] for f in found], np.full(len(a), spans[k])])
        tick, a, b, t, h, v, span = (np.concatenate(c) for c in zip(*out)) if out else [np.zeros(0, int)] * 3 + [np.zeros(0)] * 4
        rank = np.empty(len(sky.ids), int)
        rank[pc.sort_indices(sky.ids).to_numpy()] = np.arange(len(sky.ids))
        swap = rank[a] > rank[b]
        first, second = (sky.ids.take(pa.array(np.where(swap, x, y))) for x, y in ((b, a), (a, b)))
        scenario = table.column("scenario_id").combine_chunks().take(pa.array(np.zeros(len(a), int)))
        return pa.table([scenario, pa.array(tick, pa.int64()), first, second, *[pa.array(c, pa.float64()) for c in (t, h, v, span)]],
                        names=[f.split()[0] for f in schema.split(",")])

    return _framed(framed, slice_s, size).groupBy(*GROUP).applyInArrow(fold, schema)


def in_conflict(framed: DataFrame, span: float, horizontal_nm: float, vertical_ft: float, *, size: int = BLOCK, slice_s: float = SLICE_S) -> DataFrame:
    """Tracks with any conflict: scenario_id, track_id, at most once for each block that they meet.

    A task leaves out what two tracks that it has named already do to each other, so in a dense sky it looks at few pairs.
    """
    schema = "scenario_id string, track_id string"

    def fold(table: pa.Table) -> pa.Table:
        sky = _Sky(table)
        named = np.zeros(len(sky.ids), bool)
        for _, _, i, j, *_ in sky.conflicts([span], horizontal_nm, vertical_ft, named=named):
            named[sky.path[i]] = named[sky.path[j]] = True
        rows = pa.array(np.flatnonzero(named))
        return pa.table([table.column("scenario_id").combine_chunks().take(rows), sky.ids.take(rows)], names=["scenario_id", "track_id"])

    return _framed(framed, slice_s, size).groupBy(*GROUP).applyInArrow(fold, schema)


def conflict_tallies(framed: DataFrame, spans: list[float], horizontal_nm: float, vertical_ft: float, *, size: int = BLOCK, slice_s: float = SLICE_S) -> DataFrame:
    """Conflicts by scenario, lookahead and severity: how many, the soonest, and the tick of the first."""
    schema = "scenario_id string, lookahead_s double, severity string, n long, time_to_cpa_s double, first_us long"
    limits = [labels.WARNING_WITHIN_S, labels.CAUTION_WITHIN_S]
    names = ["warning", "caution", "advisory"]

    def fold(table: pa.Table) -> pa.Table:
        sky, rows = _Sky(table), {}
        for tick, k, _, _, t, _, _ in sky.conflicts(spans, horizontal_nm, vertical_ft):
            which = np.searchsorted(limits, t)
            for s in np.unique(which):
                of = t[which == s]
                n, soonest, first = rows.get((k, s), (0, np.inf, tick))
                rows[k, s] = n + len(of), min(soonest, float(of.min())), first
        scenario = table.column("scenario_id")[0].as_py()
        out = [(scenario, spans[k], names[s], *r) for (k, s), r in rows.items()]
        types = [pa.string(), pa.float64(), pa.string(), pa.int64(), pa.float64(), pa.int64()]
        columns = list(zip(*out)) if out else [()] * 6
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, types)], names=[f.split()[0] for f in schema.split(",")])

    parts = _framed(framed, slice_s, size).groupBy(*GROUP).applyInArrow(fold, schema)
    return parts.groupBy("scenario_id", "lookahead_s", "severity").agg(
        F.sum("n").alias("n"), F.min("time_to_cpa_s").alias("time_to_cpa_s"), F.min("first_us").alias("first_us")
    )


_PLACE = ["lat", "lon", "altitude_ft"]


def closest(truth: DataFrame, pairs: DataFrame, horizontal_nm: float, vertical_ft: float, *, size: int = BLOCK, slice_s: float = SLICE_S) -> DataFrame:
    """The given pairs in each slice of time they share: least distance, the height between them then, whether they conflicted.

    Asked pairs go to the group of their blocks, so no row is made for a pair and second.
    """
    dealt = cut_lineage(paths(truth, "icao24", "sec", _PLACE, slice_s, size))
    own = dealt.select("scenario_id", F.col("slice").alias("_at"), F.col("id").alias("first_icao24"), F.col("block").alias("_b1"))
    ids = dealt.select("scenario_id", F.col("slice").alias("_at"), F.col("id").alias("second_icao24"), F.col("block").alias("_b2"))
    asked = pairs.select("scenario_id", "first_icao24", "second_icao24").distinct()
    asked = asked.join(own, ["scenario_id", "first_icao24"]).join(ids, ["scenario_id", "_at", "second_icao24"])
    asked = asked.withColumns({"low": F.least("_b1", "_b2"), "high": F.greatest("_b1", "_b2")}).drop("_b1", "_b2")
    asked = asked.withColumnRenamed("_at", "slice").repartition(_width(dealt), *GROUP)
    schema = ("scenario_id string, first_icao24 string, second_icao24 string, h double, sec int, v double, conflicted boolean")
    # Tasks get this function alone: the module beside it holds functions of the session, which cannot be sent once they were used.
    distance = geo.haversine_of

    def fold(paths_: pa.Table, wanted: pa.Table) -> pa.Table:
        ids = paths_.column("id").combine_chunks()
        sec = _flat(paths_, "sec")
        out = []
        if wanted.num_rows and len(sec):
            start = int(sec.min())
            row = np.repeat(np.arange(len(ids)), pc.list_value_length(paths_.column("sec")).to_numpy())
            lat, lon, alt = (np.full((len(ids), int(sec.max()) - start + 1), np.nan) for _ in _PLACE)
            for grid, name in zip((lat, lon, alt), _PLACE):
                grid[row, sec - start] = _flat(paths_, name)
            first, second = (pc.index_in(wanted.column(c), value_set=ids).to_numpy() for c in ("first_icao24", "second_icao24"))
            for at in range(0, len(first), _PAIRS):
                a, b = first[at : at + _PAIRS], second[at : at + _PAIRS]
                h = distance(lat[a], lon[a], lat[b], lon[b])
                met = np.flatnonzero(~np.isnan(h).all(axis=1))
                a, b, h = a[met], b[met], h[met]
                v = np.abs(alt[a] - alt[b])
                when = np.nanargmin(h, axis=1) if len(h) else np.zeros(0, int)  # the earliest of equals
                k = np.arange(len(h))
                out.append([at + met, h[k, when], when + start, v[k, when], ((h < horizontal_nm) & (v < vertical_ft)).any(axis=1)])
        which, *found = (np.concatenate(c) for c in zip(*out)) if out else [np.zeros(0, int)] * 5
        own = wanted.select(["scenario_id", "first_icao24", "second_icao24"]).take(pa.array(which, pa.int64()))
        types = (pa.float64(), pa.int32(), pa.float64(), pa.bool_())
        columns = [pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(found, types)]
        return pa.table([*own.columns, *columns], names=[f.split()[0] for f in schema.split(",")])

    both = beside_each_block(dealt).groupBy(*GROUP).cogroup(asked.groupBy(*GROUP))
    return both.applyInArrow(fold, schema)

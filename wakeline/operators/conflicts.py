"""Predicted loss of separation between pairs of tracks, per scan tick.

The scan is a theta self-join, run as an equi-join in which every pair whose
swept boxes overlap meets, and meets once. A track's box is what it sweeps
within the lookahead, widened by half a standard (and, for the probabilistic
scan, by its nine-sigma uncertainty at the end of it); two tracks that breach
the standards have overlapping boxes, whatever their speed.

Altitude, which tells traffic apart best, is swept: of two overlapping boxes
the one with the higher floor has it within the other's height, so each track
stands in the band of its floor and asks in all bands of its height. East and
north, both list the squares they touch, which are wide enough that most touch
one, and a pair is kept in its lowest common square. A dense sky is spread over
bands and squares instead of becoming one hot join key.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions import probability as pr
from wakeline.functions.once import computed_once
from wakeline.operators import pair_blocks
from wakeline.operators.picture import MIN_UPDATES, eligible, in_shared_frame

# Fixed values that results depend on.
HORIZONTAL_NM = 5.0
VERTICAL_FT = 1000.0
LOOKAHEAD_S = 300.0
PARALLEL_EPSILON = 1e-12

# Cell geometry; any values give the same result. A square is about three boxes wide.
CELL_NM_PER_S = 128.0 / 300.0
BAND_FT = 1000.0
SIGMA_BAND_FT = 8000.0
_SLACK = 1e-6

_CARRIED = [
    "scenario_id", "tick_us", "track_id", "callsign", "east_nm", "north_nm", "v_east_kt", "v_north_kt",
    "altitude_ft", "vertical_rate_fpm", "vanish_tick_us",
]
_SIGMAS = ["pos_sigma_nm", "vel_sigma_kt", "alt_sigma_ft", "rate_sigma_fpm"]
_CELL = ["cx", "cy", "cz"]


def _with_sigmas(k: DataFrame) -> DataFrame:
    """Per-axis sigmas, all null unless the track carries every one of them."""
    known = (
        F.col("velocity_uncertainty_kt").isNotNull()
        & F.col("altitude_uncertainty_ft").isNotNull()
        & F.col("vertical_rate_uncertainty_fpm").isNotNull()
    )
    return k.select(
        "*",
        F.when(known, F.col("position_uncertainty_m") / 1852.0 / 2.0**0.5).alias("pos_sigma_nm"),
        F.when(known, F.col("velocity_uncertainty_kt")).alias("vel_sigma_kt"),
        F.when(known, F.col("altitude_uncertainty_ft")).alias("alt_sigma_ft"),
        F.when(known, F.col("vertical_rate_uncertainty_fpm")).alias("rate_sigma_fpm"),
    )


def _boxes(k: DataFrame, *, horizontal_nm: float, vertical_ft: float, lookahead_s: float, probabilistic: bool) -> DataFrame:
    """Add the box each track sweeps (x, y, z, each with _lo and _hi) and the squares it touches (x0..x1, y0..y1)."""
    pad_h, pad_v = F.lit(horizontal_nm / 2.0 + _SLACK), F.lit(vertical_ft / 2.0 + _SLACK)
    if probabilistic:
        # sqrt(a^2 + b^2) <= a + b: half each of the pair's cutoff is a superset.
        span_h = pr.projected_sigma(F.col("pos_sigma_nm"), 0.0, F.col("vel_sigma_kt") / 3600.0, 0.0, F.lit(lookahead_s))
        span_v = pr.projected_sigma(F.col("alt_sigma_ft"), 0.0, F.col("rate_sigma_fpm") / 60.0, 0.0, F.lit(lookahead_s))
        pad_h = pad_h + F.coalesce(span_h * pr.SIGMA_CUTOFF, F.lit(0.0))
        pad_v = pad_v + F.coalesce(span_v * pr.SIGMA_CUTOFF, F.lit(0.0))

    def reach(name: str, pos: str, rate: Column, pad: Column) -> list[Column]:
        moved = rate * lookahead_s
        return [
            (F.col(pos) + F.least(F.lit(0.0), moved) - pad).alias(f"{name}_lo"),
            (F.col(pos) + F.greatest(F.lit(0.0), moved) + pad).alias(f"{name}_hi"),
        ]

    boxed = k.select(
        "*",
        *reach("x", "east_nm", F.col("v_east_kt") / 3600.0, pad_h),
        *reach("y", "north_nm", F.col("v_north_kt") / 3600.0, pad_h),
        *reach("z", "altitude_ft", F.col("vertical_rate_fpm") / 60.0, pad_v),
    )
    # The origin of the frame is the middle of a square: a small picture is in one.
    size = CELL_NM_PER_S * max(lookahead_s, 60.0)
    squares = [F.floor(F.col(f"{n}_{end}") / size + 0.5).cast("int").alias(f"{n}{i}") for n in "xy" for i, end in enumerate(("lo", "hi"))]
    return boxed.select("*", *squares)


def closest_approach(p: DataFrame, lookahead_s: Column) -> DataFrame:
    """Time and geometry of closest approach for pairs with `a_`/`b_` columns."""
    rel = {
        n: F.col(f"b_{c}") - F.col(f"a_{c}")
        for n, c in (("e", "east_nm"), ("n", "north_nm"), ("ve", "v_east_kt"), ("vn", "v_north_kt"),
                     ("z", "altitude_ft"), ("vz", "vertical_rate_fpm"))
    }
    p = p.select("*", rel["e"].alias("re"), rel["n"].alias("rn"), (rel["ve"] / 3600.0).alias("rve"),
                 (rel["vn"] / 3600.0).alias("rvn"), rel["z"].alias("rz"), (rel["vz"] / 60.0).alias("rvz"))
    speed2 = F.col("rve") * F.col("rve") + F.col("rvn") * F.col("rvn")
    moving = speed2 >= PARALLEL_EPSILON
    raw = -(F.col("re") * F.col("rve") + F.col("rn") * F.col("rvn")) / F.when(moving, speed2)
    # Matched speeds never change the separation: the closest approach is now.
    t = F.when(moving, F.greatest(F.lit(0.0), F.least(lookahead_s, raw))).otherwise(0.0)
    p = computed_once(p, "time_to_cpa_s", t)
    return p.select(
        "*",
        F.hypot(F.col("re") + F.col("rve") * F.col("time_to_cpa_s"), F.col("rn") + F.col("rvn") * F.col("time_to_cpa_s")).alias("min_horizontal_nm"),
        F.abs(F.col("rz") + F.col("rvz") * F.col("time_to_cpa_s")).alias("min_vertical_ft"),
        F.hypot("re", "rn").alias("current_horizontal_nm"),
        F.abs("rz").alias("current_vertical_ft"),
    )


_OUT = [
    "scenario_id", "tick_us", "first_track_id", "second_track_id", "first_callsign", "second_callsign",
    "time_to_cpa_s", "min_horizontal_nm", "min_vertical_ft", "current_horizontal_nm", "current_vertical_ft",
    "lookahead_s", "probability", "vanish_tick_us",
]


def _meetings(k: DataFrame, sigmas: bool, lookahead_s: float, horizontal_nm: float, vertical_ft: float) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join on a picture's squares and bands: tracks asking in the bands of their height, tracks at their floor."""
    boxes = _boxes(
        k.select(*_CARRIED, *(_SIGMAS if sigmas else [])), horizontal_nm=horizontal_nm, vertical_ft=vertical_ft,
        lookahead_s=lookahead_s, probabilistic=sigmas,
    )
    squares = boxes.withColumn("cx", F.explode(F.sequence("x0", "x1"))).withColumn("cy", F.explode(F.sequence("y0", "y1"))).drop("x1", "y1")
    band = SIGMA_BAND_FT if sigmas else BAND_FT
    floor, top = (F.floor(F.col(c) / band).cast("int") for c in ("z_lo", "z_hi"))
    shared = ["scenario_id", "tick_us", *_CELL]
    sides = squares.withColumn("cz", F.explode(F.sequence(floor, top))), squares.withColumn("cz", floor)
    return tuple(
        side.select(*shared, *[F.col(c).alias(f"{n}_{c}") for c in side.columns if c not in shared]) for n, side in zip("ab", sides)
    )


def _met(sides: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Pairs with overlapping boxes, each once, in no order of ids."""
    a, b = sides
    # Size estimates do not see the squares' and bands' copies: never broadcast this side.
    return a.join(b.hint("merge"), ["scenario_id", "tick_us", *_CELL]).where(
        ((F.col("a_z_lo") < F.col("b_z_lo")) | ((F.col("a_z_lo") == F.col("b_z_lo")) & (F.col("a_track_id") < F.col("b_track_id"))))
        & (F.col("b_z_lo") <= F.col("a_z_hi"))
        & (F.col("cx") == F.greatest("a_x0", "b_x0"))
        & (F.col("cy") == F.greatest("a_y0", "b_y0"))
        & (F.col("a_x_lo") <= F.col("b_x_hi")) & (F.col("b_x_lo") <= F.col("a_x_hi"))
        & (F.col("a_y_lo") <= F.col("b_y_hi")) & (F.col("b_y_lo") <= F.col("a_y_hi"))
    )


def _candidates(k: DataFrame, sigmas: bool, lookaheads: list[float], horizontal_nm: float, vertical_ft: float) -> DataFrame:
    """Pairs with their closest approach, each once per lookahead."""
    longest = max(lookaheads)
    met = _met(_meetings(k, sigmas, longest, horizontal_nm, vertical_ft)).withColumn("lookahead_s", F.lit(longest))
    # Exact vertical rejection before any closest-approach arithmetic.
    slack = F.lit(0.0)
    if sigmas:
        slack = F.coalesce(
            pr.projected_sigma("a_alt_sigma_ft", "b_alt_sigma_ft", F.col("a_rate_sigma_fpm") / 60.0,
                               F.col("b_rate_sigma_fpm") / 60.0, "lookahead_s") * pr.SIGMA_CUTOFF,
            F.lit(0.0),
        )
    closing = F.abs(F.col("b_vertical_rate_fpm") - F.col("a_vertical_rate_fpm")) / 60.0 * F.col("lookahead_s")
    near = F.abs(F.col("b_altitude_ft") - F.col("a_altitude_ft")) - closing - slack < vertical_ft
    found = closest_approach(met.where(near), F.col("lookahead_s"))
    if len(lookaheads) == 1:
        return found
    # A shorter look never comes closer: only pairs that do so at the longest are judged again for each.
    close = found.where(F.col("min_horizontal_nm") < horizontal_nm).select(*met.columns)
    each = close.withColumn("lookahead_s", F.explode(F.array(*[F.lit(x) for x in lookaheads]))).where(near)
    return closest_approach(each, F.col("lookahead_s"))


def scan_size(picture: DataFrame, *, probabilistic: bool = False, lookahead_s: float = LOOKAHEAD_S, horizontal_nm: float = HORIZONTAL_NM,
              vertical_ft: float = VERTICAL_FT, min_updates: int = MIN_UPDATES) -> DataFrame:
    """One row: rows on both sides of the scan's join, pairs that meet, and all unordered pairs of the pictures."""
    k = _with_sigmas(in_shared_frame(eligible(picture, min_updates)))
    sides = _meetings(k, probabilistic, lookahead_s, horizontal_nm, vertical_ft)
    n = F.count("*")
    every = k.groupBy("scenario_id", "tick_us").agg((n * (n - 1) / 2).alias("p")).agg(F.sum("p").cast("long").alias("all_pairs"))
    counts = [side.agg(n.alias(name)) for name, side in (("asking_rows", sides[0]), ("standing_rows", sides[1]), ("pairs_met", _met(sides)))]
    for c in counts:
        every = every.crossJoin(c)  # one row each
    return every


def _named(p: DataFrame) -> DataFrame:
    """Pairs in the order of their ids, with the columns of a conflict."""
    swapped = F.col("a_track_id") > F.col("b_track_id")
    given = {
        "first_track_id": F.least("a_track_id", "b_track_id"), "second_track_id": F.greatest("a_track_id", "b_track_id"),
        "first_callsign": F.when(swapped, F.col("b_callsign")).otherwise(F.col("a_callsign")),
        "second_callsign": F.when(swapped, F.col("a_callsign")).otherwise(F.col("b_callsign")),
        "vanish_tick_us": F.least("a_vanish_tick_us", "b_vanish_tick_us"),
    }
    return p.select(*[given.get(c, F.col(c)).alias(c) for c in _OUT], *[c for c in ("threshold", ) if c in p.columns])


def predicted_conflicts(
    picture: DataFrame, *, horizontal_nm: float = HORIZONTAL_NM, vertical_ft: float = VERTICAL_FT,
    lookahead_s: float | list[float] = LOOKAHEAD_S, min_updates: int = MIN_UPDATES,
) -> DataFrame:
    """Pairs whose point estimates breach both standards at closest approach.

    A list of lookaheads is judged in one join, one output row per lookahead.
    """
    spans = list(lookahead_s) if isinstance(lookahead_s, (list, tuple)) else [float(lookahead_s)]
    k = in_shared_frame(eligible(picture, min_updates))
    p = _candidates(k, False, spans, horizontal_nm, vertical_ft)
    hit = p.where((F.col("min_horizontal_nm") < horizontal_nm) & (F.col("min_vertical_ft") < vertical_ft))
    return _named(hit.withColumn("probability", F.lit(None).cast("double")))


def in_blocks(
    picture: DataFrame, *, horizontal_nm: float = HORIZONTAL_NM, vertical_ft: float = VERTICAL_FT,
    lookahead_s: float | list[float] = LOOKAHEAD_S, min_updates: int = MIN_UPDATES, longest_only: bool = False,
) -> DataFrame:
    """`predicted_conflicts` of a dense sky: blocks of tracks are met as matrices, and no row of a pair is moved or sorted.

    The join is for a wide, thin sky; here all pairs of a picture are looked at.
    """
    spans = [float(x) for x in lookahead_s] if isinstance(lookahead_s, (list, tuple)) else [float(lookahead_s)]
    framed = in_shared_frame(eligible(picture, min_updates))
    found = pair_blocks.all_conflicts(framed, spans, horizontal_nm, vertical_ft, longest_only=longest_only)
    return found.withColumn("probability", F.lit(None).cast("double")).select(*_OUT)


def alert_spells(
    picture: DataFrame, *, horizontal_nm: float = HORIZONTAL_NM, vertical_ft: float = VERTICAL_FT,
    lookahead_s: float = LOOKAHEAD_S, min_updates: int = MIN_UPDATES, until_us: int | None = None, **kwargs,
) -> DataFrame:
    """Alerts of `predicted_conflicts` up to `until_us` (see `pair_blocks.alert_spells`)."""
    framed = in_shared_frame(eligible(picture, min_updates))
    if until_us is not None:
        framed = framed.where(F.col("tick_us") <= until_us)
    return pair_blocks.alert_spells(framed, float(lookahead_s), horizontal_nm, vertical_ft, **kwargs).withColumn("lookahead_s", F.lit(float(lookahead_s)))


def first_per_pair(
    picture: DataFrame, *, horizontal_nm: float = HORIZONTAL_NM, vertical_ft: float = VERTICAL_FT,
    lookahead_s: float | list[float] = LOOKAHEAD_S, min_updates: int = MIN_UPDATES,
) -> DataFrame:
    """Of `predicted_conflicts`, the first of each pair in a slice of time (and at each lookahead)."""
    spans = [float(x) for x in lookahead_s] if isinstance(lookahead_s, (list, tuple)) else [float(lookahead_s)]
    return pair_blocks.first_conflicts(in_shared_frame(eligible(picture, min_updates)), spans, horizontal_nm, vertical_ft)


def tallies(
    picture: DataFrame, *, horizontal_nm: float = HORIZONTAL_NM, vertical_ft: float = VERTICAL_FT,
    lookahead_s: float | list[float] = LOOKAHEAD_S, min_updates: int = MIN_UPDATES,
) -> DataFrame:
    """`predicted_conflicts` counted by scenario, lookahead and severity, without a row for each."""
    spans = [float(x) for x in lookahead_s] if isinstance(lookahead_s, (list, tuple)) else [float(lookahead_s)]
    return pair_blocks.conflict_tallies(in_shared_frame(eligible(picture, min_updates)), spans, horizontal_nm, vertical_ft)


def tracks_in_conflict(
    picture: DataFrame, counted: Column, *, horizontal_nm: float = HORIZONTAL_NM, vertical_ft: float = VERTICAL_FT,
    lookahead_s: float = LOOKAHEAD_S, min_updates: int = MIN_UPDATES,
) -> DataFrame:
    """Tracks of `predicted_conflicts` between rows that are `counted`, each once or a few times.

    Rows that are not counted still belong to their picture's frame.
    """
    framed = in_shared_frame(eligible(picture, min_updates)).where(counted)
    return pair_blocks.in_conflict(framed, float(lookahead_s), horizontal_nm, vertical_ft)


def scored_pairs(
    picture: DataFrame, *, horizontal_nm: float = HORIZONTAL_NM, vertical_ft: float = VERTICAL_FT,
    lookahead_s: float = LOOKAHEAD_S, min_updates: int = MIN_UPDATES, least: float | None = None,
) -> DataFrame:
    """Every pair that could breach, with P(both standards breached).

    `probability` is null where either track carries no uncertainty. `least`
    leaves out pairs that cannot have that probability, without working it out.
    """
    k = _with_sigmas(in_shared_frame(eligible(picture, min_updates)))
    p = _candidates(k, True, [float(lookahead_s)], horizontal_nm, vertical_ft)
    sigma_h = pr.projected_sigma("a_pos_sigma_nm", "b_pos_sigma_nm", F.col("a_vel_sigma_kt") / 3600.0,
                                 F.col("b_vel_sigma_kt") / 3600.0, "time_to_cpa_s")
    sigma_v = pr.projected_sigma("a_alt_sigma_ft", "b_alt_sigma_ft", F.col("a_rate_sigma_fpm") / 60.0,
                                 F.col("b_rate_sigma_fpm") / 60.0, "time_to_cpa_s")
    # Pairs beyond the cutoff have probability zero and can never be accepted. Disc and band lie in half-planes whose
    # chance has a closed form: where that is below `least`, so is the pair's.
    reach = pr.SIGMA_CUTOFF if least is None else min(pr.SIGMA_CUTOFF, NormalDist().inv_cdf(1.0 - least) + 1e-9 if least < 1.0 else 0.0)
    p = p.select("*", sigma_h.alias("sigma_h"), sigma_v.alias("sigma_v")).where(
        F.coalesce(F.col("min_horizontal_nm") - horizontal_nm <= reach * F.col("sigma_h"),
                   F.col("min_horizontal_nm") < horizontal_nm)
        & F.coalesce(F.col("min_vertical_ft") - vertical_ft <= reach * F.col("sigma_v"), F.lit(True))
    )
    # Judged more than once below; the integral runs once.
    return computed_once(
        p, "probability",
        pr.conflict_probability("min_horizontal_nm", "min_vertical_ft", "sigma_h", "sigma_v",
                                F.lit(horizontal_nm), F.lit(vertical_ft)),
    )


def probable_conflicts(
    picture: DataFrame, thresholds: float | list[float | None], *, horizontal_nm: float = HORIZONTAL_NM,
    vertical_ft: float = VERTICAL_FT, lookahead_s: float = LOOKAHEAD_S, min_updates: int = MIN_UPDATES,
) -> DataFrame:
    """Pairs whose breach probability reaches a threshold.

    A list of thresholds is judged in one pass and adds a `threshold` column,
    where None stands for the deterministic verdict. A pair without
    uncertainty gets the deterministic verdict at every threshold.
    """
    many = isinstance(thresholds, (list, tuple))
    levels = list(thresholds) if many else [thresholds]
    p, breach = _judgeable(picture, levels, horizontal_nm, vertical_ft, lookahead_s, min_updates)
    if not many:
        return _named(p.where(F.coalesce(F.col("probability") >= float(levels[0]), breach)))
    levels_col = F.explode(F.array(*[F.lit(x).cast("double") for x in levels]))
    judged = p.withColumn("threshold", levels_col)
    return _named(judged.where(F.coalesce(F.col("probability") >= F.col("threshold"), breach)))


def judged_pairs(
    picture: DataFrame, thresholds: list[float | None], *, horizontal_nm: float = HORIZONTAL_NM, vertical_ft: float = VERTICAL_FT,
    lookahead_s: float = LOOKAHEAD_S, min_updates: int = MIN_UPDATES,
) -> tuple[DataFrame, dict[str, dict[float | None, Column]]]:
    """What `probable_conflicts` finds at a list of thresholds, as pairs with a verdict for each instead of a row for each."""
    p, breach = _judgeable(picture, thresholds, horizontal_nm, vertical_ft, lookahead_s, min_updates)
    return _named(p), {"threshold": {x: breach if x is None else F.coalesce(F.col("probability") >= x, breach) for x in thresholds}}


def _judgeable(picture: DataFrame, levels: list[float | None], horizontal_nm: float, vertical_ft: float, lookahead_s: float,
               min_updates: int) -> tuple[DataFrame, Column]:
    """Pairs that may reach one of the levels, and the deterministic verdict on them."""
    if any(x is not None and not 0.0 < x <= 1.0 for x in levels):
        raise ValueError("thresholds must be in (0, 1]")
    # A pair that breaches by its point estimates has to stay for its deterministic verdict.
    least = min([float(x) for x in levels if x is not None] + [0.5] * (None in levels), default=None)
    p = scored_pairs(picture, horizontal_nm=horizontal_nm, vertical_ft=vertical_ft, lookahead_s=lookahead_s,
                     min_updates=min_updates, least=least)
    return p, (F.col("min_horizontal_nm") < horizontal_nm) & (F.col("min_vertical_ft") < vertical_ft)

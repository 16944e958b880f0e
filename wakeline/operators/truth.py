"""What really happened: true losses of separation and closest approaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.operators import pair_blocks, segments
from wakeline.operators.slices import SLICE_S
from wakeline.session import cut_lineage

# Fixed values that results depend on.
EVENT_BRIDGE_S = 30

# Cell geometry; any values give the same result.
_CELL_NM = 20.0
_BAND_FT = 4000.0

INSTANT = ["scenario_id", "sec"]
PAIR = ["scenario_id", "first_icao24", "second_icao24"]


def violations(truth: DataFrame, *, horizontal_nm: float = 5.0, vertical_ft: float = 1000.0) -> DataFrame:
    """Pairs inside both standards at each instant.

    The great-circle test is joined on cells of three-dimensional space: on the
    earth's sphere two points within an arc are within that distance in every
    coordinate, so there is no date line and no pole to special-case. Each
    aircraft lists the cells its half-standard box covers; a pair is kept in
    its lowest common cell only.
    """
    la, lo, r = F.radians("lat"), F.radians("lon"), geo.EARTH_RADIUS_NM
    base = truth.select(
        *INSTANT, "icao24", "lat", "lon", "altitude_ft",
        (F.cos(la) * F.cos(lo) * r).alias("px"), (F.cos(la) * F.sin(lo) * r).alias("py"), (F.sin(la) * r).alias("pz"),
    )
    h, v = horizontal_nm / 2.0 + 1e-6, vertical_ft / 2.0 + 1e-6
    axes = [("px", "cx", h, _CELL_NM), ("py", "cy", h, _CELL_NM), ("pz", "cz", h, _CELL_NM), ("altitude_ft", "cb", v, _BAND_FT)]
    cells = base
    for pos, cell, pad, size in axes:
        low = F.floor((F.col(pos) - pad) / size).cast("int")
        high = F.floor((F.col(pos) + pad) / size).cast("int")
        cells = cells.withColumn(f"{cell}0", low).withColumn(cell, F.explode(F.sequence(low, high)))
    names = [c for _, c, _, _ in axes]
    own = ["icao24", "lat", "lon", "altitude_ft", *[f"{c}0" for c in names]]
    a = cells.select(*INSTANT, *names, *[F.col(c).alias(f"a_{c}") for c in own])
    b = cells.select(*INSTANT, *names, *[F.col(c).alias(f"b_{c}") for c in own])
    # Size estimates do not see the cells' copies: never broadcast this side.
    met = a.join(b.hint("merge"), [*INSTANT, *names]).where(F.col("a_icao24") < F.col("b_icao24"))
    for c in names:
        met = met.where(F.col(c) == F.greatest(f"a_{c}0", f"b_{c}0"))
    apart = met.select(
        *INSTANT, F.col("a_icao24").alias("first_icao24"), F.col("b_icao24").alias("second_icao24"),
        F.abs(F.col("a_altitude_ft") - F.col("b_altitude_ft")).alias("vertical_ft"), "a_lat", "a_lon", "b_lat", "b_lon",
    ).where(F.col("vertical_ft") < vertical_ft)
    measured = geo.with_haversine(apart, "horizontal_nm", "a_lat", "a_lon", "b_lat", "b_lon")
    return measured.where(F.col("horizontal_nm") < horizontal_nm).drop("a_lat", "a_lon", "b_lat", "b_lon")


def conflict_events(found: DataFrame, bridge_s: int = EVENT_BRIDGE_S, slice_s: float = SLICE_S) -> DataFrame:
    """Merge violations of a pair no more than `bridge_s` apart into events."""
    parts = found.select(*PAIR, F.col("sec").alias("started_s"), F.col("sec").alias("ended_s"), "horizontal_nm", "vertical_ft")
    return joined_parts(parts, bridge_s, slice_s)


def joined_parts(parts: DataFrame, bridge_s: int = EVENT_BRIDGE_S, slice_s: float = SLICE_S) -> DataFrame:
    """Events from parts of them: a pair's parts do not overlap, and those no more than `bridge_s` apart are one event.

    A pair's parts are scanned slice by slice, however many they are.
    """
    beside = segments.neighbours(segments.sliced(parts, "started_s", slice_s), PAIR, "started_s", ["ended_s"])
    gap = F.col("started_s") - F.col("prev.ended_s")
    return (
        segments.counted(beside, PAIR, "started_s", "event_no", F.coalesce(gap > bridge_s, F.lit(True)))
        .groupBy(*PAIR, F.col("event_no").cast("int").alias("event_no"))
        .agg(
            F.min("started_s").alias("started_s"), F.max("ended_s").alias("ended_s"),
            F.min("horizontal_nm").alias("min_horizontal_nm"), F.min("vertical_ft").alias("min_vertical_ft"),
        )
    )


def copies(truth: DataFrame, block_s: int) -> DataFrame:
    """(scenario_id, block, icao24, copy_of, path): aircraft with equal states all through a block of time copy the first of them."""
    state = F.struct("sec", "lat", "lon", "altitude_ft")
    flown = truth.groupBy("scenario_id", "icao24", F.floor(F.col("sec") / block_s).alias("block")).agg(F.sort_array(F.collect_list(state)).alias("path"))
    flown = cut_lineage(flown)
    alike = ["scenario_id", "block", "path"]
    return flown.join(flown.groupBy(*alike).agg(F.min("icao24").alias("copy_of")), alike)


def event_parts(truth: DataFrame, bridge_s: int = EVENT_BRIDGE_S, *, horizontal_nm: float = 5.0, vertical_ft: float = 1000.0) -> DataFrame:
    """What `joined_parts` makes the events of `conflict_events(violations(truth))` from: one row a pair and block of time.

    A block is so short that all violations of a pair in it are of one event.
    Aircraft that fly the same path in a block meet the others once, as one, and
    only the rows found are given to each pair of them; so states are compared
    by paths, and rows are pairs x blocks instead of pairs x seconds.
    """
    spark = truth.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    flown = cut_lineage(copies(truth, bridge_s + 1))
    block = F.floor(F.col("sec") / (bridge_s + 1)).alias("block")
    states = flown.where("icao24 = copy_of").select("scenario_id", "icao24", F.inline("path"))
    apart = violations(states, horizontal_nm=horizontal_nm, vertical_ft=vertical_ft)
    # Copies of one path are in one place; a copied path meets itself.
    copied = flown.where("icao24 > copy_of").select("scenario_id", "block", F.col("copy_of").alias("icao24")).distinct()
    itself = geo.with_haversine(
        states.withColumn("block", block).join(copied, ["scenario_id", "block", "icao24"], "left_semi")
        .withColumn("vertical_ft", F.abs(F.col("altitude_ft") - F.col("altitude_ft"))),
        "horizontal_nm", "lat", "lon", "lat", "lon",
    ).where((F.col("horizontal_nm") < horizontal_nm) & (F.col("vertical_ft") < vertical_ft))
    together = itself.select(*INSTANT, F.col("icao24").alias("first_icao24"), F.col("icao24").alias("second_icao24"), "horizontal_nm", "vertical_ft")
    met = apart.select(*together.columns).unionByName(together).groupBy(*PAIR, block).agg(
        F.min("sec").alias("started_s"), F.max("sec").alias("ended_s"),
        F.min("horizontal_nm").alias("horizontal_nm"), F.min("vertical_ft").alias("vertical_ft"),
    )
    a, b = (
        flown.select("scenario_id", "block", F.col("copy_of").alias(f"{n}_icao24"), F.col("icao24").alias(n)) for n in ("first", "second")
    )
    # A row becomes one a pair of copies: small partitions must not be merged before that.
    spread = met.join(a, ["scenario_id", "block", "first_icao24"]).repartition(width, "scenario_id", "block", "second_icao24")
    each = spread.join(b, ["scenario_id", "block", "second_icao24"]).where("first_icao24 <> second_icao24 or first < second")
    return each.select(
        "scenario_id", F.least("first", "second").alias("first_icao24"), F.greatest("first", "second").alias("second_icao24"),
        "started_s", "ended_s", "horizontal_nm", "vertical_ft",
    )


def closest_approach(truth: DataFrame, pairs: DataFrame, *, horizontal_nm: float = 5.0, vertical_ft: float = 1000.0) -> DataFrame:
    """How near the given pairs ever came, the vertical gap then, and whether they conflicted.

    Only pairs somebody asked about are followed, and never as a row for each
    second: they are looked up in blocks of paths.
    """
    parts = pair_blocks.closest(truth, pairs, horizontal_nm, vertical_ft)
    return parts.groupBy(*PAIR).agg(
        F.min("h").alias("true_min_horizontal_nm"),
        F.min_by("v", F.struct("h", "sec")).alias("true_vertical_at_closest_ft"),
        F.bool_or("conflicted").alias("ever_conflicted"),
    )

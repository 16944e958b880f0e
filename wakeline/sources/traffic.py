"""Telemetry derived from the `events` table: one user is one aircraft.

The provided tables hold no position reports, so reports, truth and manoeuvre
plans are a deterministic projection of `events`: the report instants are the
user's event instants on a compressed clock, and the kinematics are closed form
in (user, time). Everything grows with `events`; nothing is generated apart
from it. Aircraft are dealt to eight sectors, so pictures grow with the data;
every sector is a scenario.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.functions.once import computed_once
from wakeline.sources import streams

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z
CLOCK_COMPRESSION = 10_000
SECTORS = 8
SECTOR_LAT = 40.6
LEVEL_OFF_S = 120.0
TURN_START_S, TURN_END_S, TURN_RATE_DEG_S = 120.0, 150.0, 3.0
DIVE_START_S, DIVE_END_S = 60.0, 90.0
CLIMB_FPM, DIVE_FPM = 1500.0, 6500.0
NOISE_PRIME = 10_007
END_STEP_US = 10_000_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` with the compressed clock in microseconds."""
    e = load(spark, sf_dir, "events")
    # The column may arrive with or without a time zone; the difference to a
    # zone-free origin is the same for a UTC wall clock either way.
    offset = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return e.withColumn("t_us", F.lit(EPOCH_US) + F.floor(offset / CLOCK_COMPRESSION).cast("long"))


_ends: dict[tuple[str, str], int | None] = {}


def end_of_data(spark: SparkSession, sf_dir: str) -> int:
    """The first multiple of ten seconds at or after the last report, in microseconds.

    Plans of one application ask for it several times; a table is read for it once.
    """
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _ends:
        _ends[known] = events(spark, sf_dir).agg(F.max("t_us").alias("t")).first()["t"]
    last = _ends[known]
    return EPOCH_US + -(-((last or EPOCH_US) - EPOCH_US) // END_STEP_US) * END_STEP_US


def sector(u: Column) -> Column:
    return F.pmod(u, F.lit(SECTORS)).cast("long")


def member(u: Column) -> Column:
    """Number of an aircraft within its sector."""
    return F.floor(u / SECTORS).cast("long")


def is_diving(i: Column) -> Column:
    return F.pmod(i, F.lit(20)) == 7


def identity(u: Column) -> dict[str, Column]:
    return {
        "scenario_id": F.concat(F.lit("sector-"), sector(u).cast("string")),
        "icao24": F.lower(F.lpad(F.hex(u), 6, "0")),
    }


def kinematics(u: Column, t: Column) -> dict[str, Column]:
    """True state of aircraft `u` at `t` seconds after the epoch."""
    s, i = sector(u), member(u)
    lon0 = F.pmod(s, F.lit(24)) * 10.0 - 120.0
    bearing = F.pmod(i * 137 + s * 11, F.lit(360)).cast("double")
    start_nm = F.pmod(i * 29 + s * 7, F.lit(40)) + 12.0
    speed = F.pmod(i * 53 + s * 17, F.lit(120)) + 380.0
    v = speed / 3600.0
    turner = F.pmod(i, F.lit(3)) == 0
    h0 = F.radians(bearing + 180.0)
    straight = F.when(turner, F.least(t, F.lit(TURN_START_S))).otherwise(t)
    arc_s = F.least(F.greatest(t - TURN_START_S, F.lit(0.0)), F.lit(TURN_END_S - TURN_START_S))
    after_s = F.greatest(t - TURN_END_S, F.lit(0.0))
    rate = math.radians(TURN_RATE_DEG_S)
    r = v / rate
    h1 = h0 + math.radians(TURN_RATE_DEG_S * (TURN_END_S - TURN_START_S))
    east = start_nm * F.sin(F.radians(bearing)) + v * straight * F.sin(h0)
    north = start_nm * F.cos(F.radians(bearing)) + v * straight * F.cos(h0)
    arc_e = r * (F.cos(h0) - F.cos(h0 + arc_s * rate)) + v * after_s * F.sin(h1)
    arc_n = r * (F.sin(h0 + arc_s * rate) - F.sin(h0)) + v * after_s * F.cos(h1)
    climb = (
        F.when(F.pmod(i, F.lit(5)) == 0, CLIMB_FPM)
        .when(F.pmod(i, F.lit(5)) == 1, -CLIMB_FPM)
        .otherwise(0.0)
    )
    dive = F.when(is_diving(i), -DIVE_FPM).otherwise(0.0)
    dive_s = F.least(F.greatest(t - DIVE_START_S, F.lit(0.0)), F.lit(DIVE_END_S - DIVE_START_S))
    altitude = (
        F.lit(30000.0)
        + F.pmod(i + s, F.lit(5)) * 1000.0
        + F.pmod(i, F.lit(3)) * 400.0
        + climb * F.least(t, F.lit(LEVEL_OFF_S)) / 60.0
        + dive * dive_s / 60.0
    )
    vrate = F.when(t < LEVEL_OFF_S, climb).otherwise(0.0) + F.when(
        (t >= DIVE_START_S) & (t < DIVE_END_S), dive
    ).otherwise(0.0)
    return {
        "lat0": F.lit(SECTOR_LAT),
        "lon0": lon0,
        "east": F.when(turner, east + arc_e).otherwise(east),
        "north": F.when(turner, north + arc_n).otherwise(north),
        "speed": speed,
        "heading": F.when(turner, bearing + 180.0 + arc_s * TURN_RATE_DEG_S).otherwise(
            bearing + 180.0
        ),
        "altitude": altitude,
        "vrate": vrate,
        "turning_deg": F.when(
            turner & (t >= TURN_START_S) & (t < TURN_END_S), (F.lit(TURN_END_S) - t) * TURN_RATE_DEG_S
        ).otherwise(0.0),
    }


def _noise(event_id: Column, a: int, b: int) -> Column:
    """Uniform in [-sqrt(3), sqrt(3)), so one unit of scale is one sigma."""
    return (F.pmod(event_id * a + b, F.lit(NOISE_PRIME)) / float(NOISE_PRIME) * 2.0 - 1.0) * math.sqrt(3.0)


#: Columns of the event behind a report that a caller may carry along.
EVENT = {"event_id": "event_id", "event_type": "event_type", "props": "props", "size": "value", "user_id": "user_id"}


def reports(spark: SparkSession, sf_dir: str, *carried: str) -> DataFrame:
    """Noisy, incomplete position reports: what a sensor layer would have seen.

    `carried` names columns of EVENT to keep beside each report.
    """
    u, eid = F.col("user_id"), F.col("event_id")
    t = (F.col("t_us") - EPOCH_US) / 1e6
    k = kinematics(u, t)
    base = events(spark, sf_dir).select(
        "event_id", "event_type", "value", "t_us", *[F.col(EVENT[c]).alias(f"of_{c}") for c in carried],
        *[c.alias(n) for n, c in identity(u).items()],
        F.concat(F.lit("AC"), F.lpad(u.cast("string"), 6, "0")).alias("sign"),
        *[c.alias(n) for n, c in k.items()],
        *[
            _noise(eid, a, b).alias(n)
            for n, a, b in (
                ("n_e", 7919, 11), ("n_n", 6101, 503), ("n_z", 4603, 29), ("n_v", 3571, 71), ("n_h", 2741, 97),
            )
        ],
    )
    place = geo.from_local_enu(
        "lat0", "lon0", F.col("east") + F.col("n_e") * (30.0 / 1852.0), F.col("north") + F.col("n_n") * (30.0 / 1852.0)
    )
    base = computed_once(base, "place", place)
    kind = F.col("event_type")
    has_velocity = kind != "signup"
    # Reports are quantised the way a transponder would, which also keeps the
    # values independent of the last bit of a platform's trigonometry.
    return base.select(
        "scenario_id",
        F.concat_ws("-", "scenario_id", F.lpad(eid.cast("string"), 9, "0")).alias("report_id"),
        "icao24",
        F.when(kind != "click", F.col("sign")).alias("callsign"),
        "t_us",
        F.round("place.lat", 6).alias("lat"),
        F.round("place.lon", 6).alias("lon"),
        F.when(kind != "error", F.round(F.col("altitude") + F.col("n_z") * 25.0, 2)).alias("altitude_baro_ft"),
        F.when(has_velocity, F.round(F.col("speed") + F.col("n_v") * 2.0, 2)).alias("ground_speed_kt"),
        F.when(
            has_velocity, F.round(F.pmod(F.round(F.col("heading") + F.col("n_h") * 0.5, 2), F.lit(360.0)), 2)
        ).alias("track_deg"),
        F.when(has_velocity, F.col("vrate")).alias("vertical_rate_fpm"),
        F.when((kind == "purchase") & (F.col("value") >= 150.0), "7700")
        .when(kind == "view", "1200")
        .alias("squawk"),
        F.lit(False).alias("on_ground"),
        *[F.col(f"of_{c}").alias(c) for c in carried],
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last report instant of every aircraft (map-side combined)."""
    return events(spark, sf_dir).groupBy("user_id").agg(
        F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us")
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise-free state once per second while an aircraft is active."""
    # A row an aircraft becomes one a second: small partitions of aircraft must not be merged first.
    spread = activity(spark, sf_dir).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    span = spread.select(
        "user_id",
        F.explode(
            F.sequence(
                F.ceil((F.col("first_us") - EPOCH_US) / 1e6).cast("int"),
                F.greatest(
                    F.ceil((F.col("first_us") - EPOCH_US) / 1e6), F.floor((F.col("last_us") - EPOCH_US) / 1e6)
                ).cast("int"),
            )
        ).alias("sec"),
    )
    u, t = F.col("user_id"), F.col("sec").cast("double")
    rows = span.select("sec", *[c.alias(n) for n, c in identity(u).items()],
                       *[c.alias(n) for n, c in kinematics(u, t).items()])
    rows = computed_once(rows, "place", geo.from_local_enu("lat0", "lon0", "east", "north"))
    return rows.select(
        "scenario_id", "icao24", "sec",
        F.round("place.lat", 6).alias("lat"),
        F.round("place.lon", 6).alias("lon"),
        F.round("altitude", 2).alias("altitude_ft"),
        F.col("speed").alias("ground_speed_kt"),
        F.round(F.pmod(F.round("heading", 2), F.lit(360.0)), 2).alias("track_deg"),
        F.col("vrate").alias("vertical_rate_fpm"),
        geo.flight_phase("vrate", "turning_deg").alias("phase"),
    )


def manoeuvres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripted commands of every aircraft: (scenario, icao24, at_s, kind)."""
    u = F.col("user_id")
    i = member(u)
    climbs = F.pmod(i, F.lit(5)).isin(0, 1)
    plan = F.filter(
        F.array(
            F.when(climbs, F.struct(F.lit(0.0).alias("at_s"), F.lit("ClimbTo").alias("kind"))),
            F.when(is_diving(i), F.struct(F.lit(DIVE_START_S).alias("at_s"), F.lit("ClimbTo").alias("kind"))),
            F.when(climbs, F.struct(F.lit(LEVEL_OFF_S).alias("at_s"), F.lit("ClimbTo").alias("kind"))),
            F.when(
                F.pmod(i, F.lit(3)) == 0,
                F.struct(F.lit(TURN_START_S).alias("at_s"), F.lit("TurnTo").alias("kind")),
            ),
        ),
        lambda c: c.isNotNull(),
    )
    return (
        activity(spark, sf_dir)
        .select(*[c.alias(n) for n, c in identity(u).items()], F.explode(plan).alias("c"))
        .select("scenario_id", "icao24", "c.at_s", "c.kind")
    )


def report_records(spark: SparkSession, sf_dir: str, *carried: str) -> DataFrame:
    """Reports as contract records (timestamps instead of microseconds)."""
    r = reports(spark, sf_dir, *carried)
    return r.select(
        F.lit("wakeline-contracts-v1").alias("schema_version"), "report_id", "icao24", "callsign",
        F.timestamp_micros("t_us").alias("observed_at"), "lat", "lon", "altitude_baro_ft", "ground_speed_kt", "track_deg",
        "vertical_rate_fpm", "squawk", "on_ground", F.lit("simulator").alias("source"), "scenario_id", *carried,
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as keyed JSON messages with delivery metadata; extreme event values break their record."""
    keyed = streams.to_messages(report_records(spark, sf_dir, *EVENT), "icao24", tuple(EVENT))
    big, v, kind = F.col("size") >= 100.0, F.col("value"), F.col("event_type")
    broken = (
        F.when(F.col("size") < 5.0, F.substring(v, 1, 40))
        .when(F.col("size").between(20.0, 25.0), F.regexp_replace(v, r"(:\d\d)\.\d{6}Z", "$1Z"))
        .when((F.col("size") > 25.0) & (F.col("size") < 26.0), F.regexp_replace(v, r'"observed_at":"[^"]+"', '"observed_at":"yesterday"'))
        .when(big & (kind == "click"), F.regexp_replace(v, r"^\{", '{"extra":1,'))
        .when(big & (kind == "view"), F.regexp_replace(v, r'"lat":[-0-9.]+', '"lat":95.0'))
        .when(big & (kind == "error"), F.regexp_replace(v, r'"icao24":"[0-9a-f]+"', '"icao24":"XYZ"'))
        .when(big & (kind == "signup"), F.regexp_replace(v, r"^\{", '{"squawk":"9999",'))
        .when(big & (kind == "purchase") & (F.col("size") < 150.0), F.regexp_replace(v, r'"report_id":"[^"]+",', ""))
        .otherwise(v)
    )
    header = F.struct(F.lit("correlation_id").alias("key"), F.get_json_object("props", "$.k").cast("binary").alias("value"))
    return keyed.select(
        "key", broken.alias("value"), F.lit("surveillance.reports.v1").alias("topic"),
        F.pmod("user_id", F.lit(6)).cast("int").alias("partition"), F.col("event_id").alias("offset"),
        F.when(kind == "view", F.array(header)).otherwise(F.array().cast(streams.HEADERS)).alias("headers"),
    )


def scenario_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested scenario documents, as a scenario generator would deliver them."""
    plan = manoeuvres(spark, sf_dir).groupBy("scenario_id", "icao24").agg(
        F.array_sort(F.collect_list(F.struct("at_s", "kind"))).alias("plan")
    )
    u = F.col("user_id")
    fleet = activity(spark, sf_dir).select(
        *[c.alias(n) for n, c in identity(u).items()],
        F.concat(F.lit("AC"), F.lpad(u.cast("string"), 6, "0")).alias("callsign"),
        ((F.col("first_us") - EPOCH_US) / 1e6).alias("entry_time_s"),
    )
    a = fleet.join(plan, ["scenario_id", "icao24"], "left")
    return a.groupBy("scenario_id").agg(F.collect_list(F.struct("icao24", "callsign", "entry_time_s", "plan")).alias("aircraft")).select(
        "scenario_id", F.lit((end_of_data(spark, sf_dir) - EPOCH_US) / 1e6).alias("duration_s"), "aircraft"
    )

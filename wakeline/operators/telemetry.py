"""Operational rollups: counters, rates, latency quantiles, consumer lag."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values that results depend on: upper bounds in seconds.
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
LATENCY_QUANTILES = (0.5, 0.95, 0.99)


def counters(rows: DataFrame, t_us: str, *dims: str, every_s: int = 60) -> DataFrame:
    """Occurrences per tumbling interval and label combination."""
    step = every_s * 1_000_000
    return rows.groupBy((F.floor(F.col(t_us) / step) * step).alias("window_us"), *dims).agg(F.count("*").alias("n"))


def rates(rows: DataFrame, t_us: str, *dims: str, every_s: int = 60) -> DataFrame:
    return counters(rows, t_us, *dims, every_s=every_s).withColumn("per_second", F.col("n") / float(every_s))


def stream_counters(rows: DataFrame, time: str, *dims: str, every: str = "1 minute", late: str = "30 seconds") -> DataFrame:
    """The same rollup on a stream, closed by a watermark."""
    return rows.withWatermark(time, late).groupBy(F.window(time, every), *dims).count()


def histogram(rows: DataFrame, value: str, *dims: str, bounds: list[float] | None = None) -> DataFrame:
    """Cumulative bucket counts per label combination, Prometheus style."""
    edges = bounds or LATENCY_BUCKETS
    counts = [F.count_if(F.col(value) <= b).alias(f"le{i}") for i, b in enumerate(edges)]
    wide = rows.groupBy(*dims).agg(*counts, F.count(value).alias("total"))
    buckets = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"le{i}").alias("cum")) for i, b in enumerate(edges)])
    return wide.select(*dims, "total", F.explode(buckets).alias("b")).select(*dims, "total", "b.le", "b.cum")


def histogram_quantiles(hist: DataFrame, *dims: str, qs: tuple[float, ...] = LATENCY_QUANTILES) -> DataFrame:
    """Quantiles interpolated linearly inside their bucket; beyond the ladder its last bound."""
    w = Window.partitionBy(*dims).orderBy("le")
    lower = hist.select("*", F.lag("le", 1, 0.0).over(w).alias("low"), F.lag("cum", 1, 0).over(w).alias("below"))
    each = lower.withColumn("q", F.explode(F.array(*[F.lit(q) for q in qs])))
    rank = F.col("q") * F.col("total")
    hit = (F.col("below") < rank) & (F.col("cum") >= rank)
    inside = F.col("low") + (F.col("le") - F.col("low")) * (rank - F.col("below")) / F.when(F.col("cum") > F.col("below"), F.col("cum") - F.col("below"))
    return each.groupBy(*dims, "q").agg(F.coalesce(F.max(F.when(hit, inside)), F.max("le")).alias("value"))


def gauge(intervals: DataFrame, start_us: str, end_us: str, *dims: str, every_s: int = 60) -> DataFrame:
    """How many intervals hold each full minute (or `every_s`): dims, at_us, n.

    An interval holds its start and not its end; without an end it never ends.
    A sweep: starts count up and ends count down at the next minute, and a
    running sum is repeated until it changes. No interval is laid out minute by
    minute, and only one number a minute is shuffled and sorted. Minutes run
    from a label's first start to its last start or end.
    """
    step = every_s * 1_000_000
    marks = F.array(F.struct(F.ceil(F.col(start_us) / step).alias("m"), F.lit(1).alias("d")), F.struct(F.ceil(F.col(end_us) / step).alias("m"), F.lit(-1).alias("d")))
    deltas = intervals.select(*dims, F.explode(marks).alias("x")).where("x.m is not null").groupBy(*dims, F.col("x.m").alias("m")).agg(F.sum("x.d").alias("d"))
    along = Window.partitionBy(*dims).orderBy("m")
    held = deltas.select(*dims, "m", F.sum("d").over(along).alias("n"), F.lead("m").over(along).alias("until"))
    each = held.select(*dims, "n", F.explode(F.sequence(F.col("m"), F.coalesce(F.col("until") - 1, F.col("m")))).alias("m"))
    return each.select(*dims, (F.col("m") * step).alias("at_us"), "n")


def consumer_lag(consumed: DataFrame, heads: DataFrame) -> DataFrame:
    """Messages not yet consumed per assigned partition; lost partitions drop out."""
    done = consumed.groupBy("topic", "partition").agg(F.max("offset").alias("offset"))
    return heads.join(done, ["topic", "partition"]).select(
        "topic", "partition", F.greatest(F.lit(0), F.col("head") - (F.col("offset") + 1)).alias("lag")
    )


def totals(**parts: DataFrame) -> DataFrame:
    """One row per named output with its row count."""
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out

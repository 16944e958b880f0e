"""Exact quantiles of large groups without collecting a group anywhere.

Values are counted (with map-side combine) in ordered buckets, running counts
over the buckets locate each wanted rank, and only the buckets that hold a
wanted rank are looked at value by value. Three definitions coexist:
`index` takes element floor(q*n) of the sorted values, `median` the mean of
the middle one or two, `linear` interpolates at q*(n-1).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Quantile:
    name: str
    q: float
    method: str = "index"
    min_count: int = 1

    def position(self, n: Column) -> Column:
        """Fractional zero-based position among `n` sorted values."""
        if self.method == "index":
            # q*n for q = a/b is evaluated in integers: a*n div b.
            num, den = self.q.as_integer_ratio() if self.q in (0.0, 0.5, 1.0) else (round(self.q * 1000), 1000)
            return F.least(F.floor(n * num / den), n - 1).cast("double")
        if self.method == "median":
            return (n - 1) / 2.0
        return (n - 1) * self.q


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: list[Quantile], *, width: float | None = None,
              weight: str | None = None) -> DataFrame:
    """One row per key with `n` and a column per wanted quantile.

    `width` is the bucket size for continuous values; None means the values
    are already discrete (whole seconds, say), and each value is its bucket.
    `weight` is an integer repetition count per row.
    """
    one = F.sum(weight) if weight else F.count("*")
    v = F.col(value)
    rows = df.where(v.isNotNull())
    bucket = v if width is None else F.floor(v / width)
    hist = rows.groupBy(*keys, bucket.alias("bucket")).agg(one.cast("long").alias("c"))
    if weight:
        hist = hist.where("c > 0")
    by_bucket = Window.partitionBy(*keys).orderBy("bucket")
    whole = Window.partitionBy(*keys)
    cum = hist.select("*", F.sum("c").over(by_bucket).alias("upto"), F.sum("c").over(whole).alias("n"))
    ranks = F.array_distinct(
        F.flatten(F.array(*[F.array(F.floor(q.position(F.col("n"))), F.ceil(q.position(F.col("n")))) for q in wanted]))
    )
    held = cum.withColumn("rank", F.explode(F.filter(ranks, lambda r: (r >= F.col("upto") - F.col("c")) & (r < F.col("upto")))))
    if width is None:
        picked = held.select(*keys, "n", "rank", F.col("bucket").cast("double").alias("x"))
    else:
        need = held.select(*keys, "bucket", "n", "rank", (F.col("upto") - F.col("c")).alias("below"))
        which = need.select(*keys, "bucket").distinct()
        inside = (
            rows.withColumn("bucket", bucket)
            .join(which, [*keys, "bucket"], "left_semi")
            .groupBy(*keys, "bucket", v.alias("x"))
            .agg(one.cast("long").alias("c"))
        )
        run = Window.partitionBy(*keys, "bucket").orderBy("x")
        exact = inside.withColumn("upto", F.sum("c").over(run))
        picked = (
            need.join(exact, [*keys, "bucket"])
            .where((F.col("rank") - F.col("below") >= F.col("upto") - F.col("c")) & (F.col("rank") - F.col("below") < F.col("upto")))
            .select(*keys, "n", "rank", "x")
        )
    n = F.col("n")
    out = []
    for q in wanted:
        pos = q.position(n)
        low = F.max(F.when(F.col("rank") == F.floor(pos), F.col("x")))
        high = F.max(F.when(F.col("rank") == F.ceil(pos), F.col("x")))
        frac = F.first(pos - F.floor(pos))
        val = low + (high - low) * frac
        if q.min_count > 1:
            val = F.when(F.first(n) >= q.min_count, val)
        out.append(val.alias(q.name))
    return picked.groupBy(*keys).agg(F.first("n").alias("n"), *out)


def resampled_medians(values: DataFrame, times: DataFrame, keys: list[str], unit: str, value: str, width: float) -> DataFrame:
    """Median per key and resample `b`: (keys, b, median).

    `values` has keys, `unit`, `value` and how often it occurs (`c`); `times`
    has b, `unit` and how often the resample drew the unit. Values are first
    counted in buckets, so a resample is a histogram; only buckets that hold the
    median of some resample are then looked at value by value. What is shuffled
    is bounded by buckets times resamples, not by values.
    """
    ids = [*keys, "b"]
    bucketed = values.withColumn("bucket", F.floor(F.col(value) / width))
    coarse = bucketed.groupBy(*keys, unit, "bucket").agg(F.sum("c").alias("c"))
    hist = coarse.join(times, unit).groupBy(*ids, "bucket").agg(F.sum(F.col("c") * F.col("times")).alias("c"))
    along, whole = Window.partitionBy(*ids).orderBy("bucket"), Window.partitionBy(*ids)
    cum = hist.select("*", F.sum("c").over(along).alias("upto"), F.sum("c").over(whole).alias("n"))
    middle = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    below = F.col("upto") - F.col("c")
    held = cum.withColumn("rank", F.explode(F.filter(middle, lambda r: (r >= below) & (r < F.col("upto"))))).select(*ids, "bucket", (F.col("rank") - below).alias("place"))
    some = bucketed.join(held.select(*keys, "bucket").distinct(), [*keys, "bucket"], "left_semi")
    inside = some.join(times, unit).join(held.select(*ids, "bucket").distinct(), [*ids, "bucket"], "left_semi")
    counts = inside.groupBy(*ids, "bucket", value).agg(F.sum(F.col("c") * F.col("times")).alias("c"))
    exact = counts.select("*", F.sum("c").over(Window.partitionBy(*ids, "bucket").orderBy(value)).alias("upto"))
    found = held.join(exact, [*ids, "bucket"]).where((F.col("place") >= F.col("upto") - F.col("c")) & (F.col("place") < F.col("upto")))
    # One row where the middle is one value, else two.
    return found.groupBy(*ids).agg(((F.min(value) + F.max(value)) / 2.0).alias("median"))

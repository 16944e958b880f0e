"""Cluster bootstrap: resample scenarios, never the correlated rows inside them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from wakeline.operators.quantiles import Quantile, quantiles, resampled_medians
from wakeline.session import cut_lineage

PAIRED_RESAMPLES = 10_000
MEDIAN_RESAMPLES = 400


def draw(seed: int, *parts: Column) -> Column:
    """Uniform integer in [0, 2^32) that depends only on its arguments."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def picks(scenarios: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(b, scenario_id, times): how often each resample drew each scenario.

    Every draw is a hash of (resample, draw number), so draws need no order, no
    driver and no shared generator; they are counted map-side before the
    shuffle. `scenarios` holds one row per scenario and is numbered by rank
    inside hash buckets plus bucket offsets, without a global sort.
    """
    ids = numbered(scenarios.select("scenario_id"))
    # One row, whatever the data: safe to broadcast.
    total = F.broadcast(ids.agg(F.count("*").alias("n_all"), F.lit(1).alias("one")))
    # One draw per (scenario, resample): the scenario row only lends the draw number.
    each = ids.withColumn("one", F.lit(1)).join(total, "one").withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))
    )
    chosen = F.pmod(draw(seed, F.col("b"), F.col("idx")), F.col("n_all"))
    drawn = each.groupBy("b", chosen.alias("idx")).agg(F.count("*").alias("times"))
    return drawn.join(ids, "idx").select("b", "scenario_id", "times")


def numbered(ids: DataFrame, buckets: int = 1024) -> DataFrame:
    """Dense 0-based index per id: rank within a hash bucket plus the bucket's offset."""
    b = ids.withColumn("hb", F.pmod(draw(0, F.col("scenario_id")), F.lit(buckets)))
    offsets = b.groupBy("hb").agg(F.count("*").alias("c")).withColumn(
        "base", F.sum("c").over(Window.orderBy("hb")) - F.col("c")
    )
    ranked = b.withColumn("r", F.row_number().over(Window.partitionBy("hb").orderBy("scenario_id")) - 1)
    return ranked.join(offsets, "hb").select("scenario_id", (F.col("base") + F.col("r")).cast("long").alias("idx"))


def outcome_classes(per_scenario: DataFrame, arm: str, *, buckets: int = 1024) -> DataFrame:
    """(idx, c, outcomes): each distinct set of outcomes over all arms, numbered from 0, and how many scenarios have it."""
    row = F.struct(F.col(arm), F.col("alerts").cast("long").alias("alerts"), F.col("false_alerts").cast("long").alias("false_alerts"))
    classes = per_scenario.groupBy("scenario_id").agg(F.sort_array(F.collect_list(row)).alias("outcomes"))  # one entry for each arm
    classes = classes.groupBy("outcomes").agg(F.count("*").alias("c"))
    name = F.array_join(F.transform("outcomes", lambda o: F.concat_ws(":", o[arm], o["alerts"], o["false_alerts"])), ",")
    named = cut_lineage(classes.withColumn("scenario_id", name))
    return named.join(numbered(named.select("scenario_id"), buckets), "scenario_id").select("idx", "c", "outcomes")


def class_draws(classes: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(b, idx, times): multinomial counts of the classes in each resample, as drawing scenario by scenario gives.

    A binary tree stands over the numbered classes. The root of resample b draws
    all scenarios; a node that draws n of them gives Binomial(n, share of its
    left half) to the left and the rest to the right. Nodes without draws end, so
    rows are at most classes x resamples, however many scenarios there are, and a
    draw depends on nothing but its resample and its node.
    """
    classes = cut_lineage(classes.select(F.col("idx").cast("long").alias("idx"), F.col("c").cast("long").alias("c")))
    last = classes.agg(F.max("idx")).first()[0]
    if last is None:
        return classes.sparkSession.createDataFrame([], "b long, idx long, times long")
    depth = int(last).bit_length()

    def nodes(level: int) -> DataFrame:
        return classes.groupBy(F.shiftright("idx", depth - level).alias("node")).agg(F.sum("c").alias("size"))

    root = nodes(0).select("node", "size", F.col("size").alias("n"))
    rows = root.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long")))).select("b", "node", "size", "n")
    for level in range(1, depth + 1):
        left = nodes(level).where("node % 2 = 0").select((F.col("node") / 2).cast("long").alias("node"), F.col("size").alias("left_size"))
        u = (draw(seed, F.col("b"), F.lit(level), F.col("node")) + 0.5) / float(2**32)
        split = rows.join(left, "node", "left").withColumn("left_size", F.coalesce("left_size", F.lit(0)))
        split = split.withColumn("left_n", binomial_quantile(u, "n", F.col("left_size") / F.col("size")))
        halves = F.array(
            F.struct((2 * F.col("node")).alias("node"), F.col("left_size").alias("size"), F.col("left_n").alias("n")),
            F.struct((2 * F.col("node") + 1).alias("node"), (F.col("size") - F.col("left_size")).alias("size"), (F.col("n") - F.col("left_n")).alias("n")),
        )
        rows = split.select("b", F.inline(halves)).where("n > 0")
    return rows.select("b", F.col("node").alias("idx"), F.col("n").alias("times"))


@F.pandas_udf(LongType())
def _binomial_quantile(u: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series(binomial_quantiles(u.to_numpy(), n.to_numpy(), p.to_numpy()))


def binomial_quantile(u: Column, n: str, p: Column) -> Column:
    """Least k with P(Binomial(n, p) <= k) > u."""
    return _binomial_quantile(u, F.col(n), p)


def binomial_quantiles(u: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Least k with P(Binomial(n, p) <= k) > u, row by row; probabilities of equal (n, p) are computed once.

    Summed over nine standard deviations around the mean; what lies beyond has
    less weight than the steps of u.
    """
    out = np.zeros(len(u), np.int64)
    pairs, which = np.unique(np.stack([n.astype(float), p]), axis=1, return_inverse=True)
    order = np.argsort(which, kind="stable")
    ends = np.searchsorted(which[order], np.arange(pairs.shape[1] + 1))
    for i, (size, share) in enumerate(pairs.T):
        rows = order[ends[i] : ends[i + 1]]
        if share <= 0 or share >= 1:
            out[rows] = size if share >= 1 else 0
            continue
        reach = 9 * math.sqrt(size * share * (1 - share)) + 20
        low, high = max(0, int(size * share - reach)), min(int(size), int(size * share + reach))
        k = np.arange(low, high, dtype=float)
        # Log probability of the first, then ratios of neighbours.
        first = math.lgamma(size + 1) - math.lgamma(low + 1) - math.lgamma(size - low + 1) + low * math.log(share) + (size - low) * math.log1p(-share)
        steps = np.log(size - k) - np.log(k + 1) + math.log(share) - math.log1p(-share)
        upto = np.cumsum(np.exp(np.concatenate([[first], first + np.cumsum(steps)])))
        out[rows] = low + np.minimum(np.searchsorted(upto, u[rows], side="right"), high - low)
    return out


def paired_precision_delta(per_scenario: DataFrame, *, arm: str, baseline: Column, resamples: int = PAIRED_RESAMPLES,
                           seed: int = 20260816) -> DataFrame:
    """95 % interval of each arm's precision minus the baseline's.

    `per_scenario` has scenario_id, `arm`, alerts, false_alerts for every arm
    of every scenario. All arms are resampled with the same draws. Scenarios of
    equal outcomes are one class, and a resample draws how often each class
    occurs, so the work grows with different outcomes, not with scenarios.
    """
    classes = cut_lineage(outcome_classes(per_scenario, arm))
    rows = classes.select("idx", "c", F.inline("outcomes"))
    base = rows.where(baseline).select("idx", F.col("alerts").alias("ba"), F.col("false_alerts").alias("bf"))
    both = rows.where(~F.coalesce(baseline, F.lit(False))).join(base, "idx")
    p = class_draws(classes, resamples, seed)

    def precision(alerts: Column, false: Column) -> Column:
        return F.when(alerts > 0, (alerts - false) / alerts)

    def difference(t: Column) -> Column:
        return precision(F.sum(t * F.col("alerts")), F.sum(t * F.col("false_alerts"))) - precision(F.sum(t * F.col("ba")), F.sum(t * F.col("bf")))

    per_b = both.join(p, "idx").groupBy(arm, "b").agg(F.round(difference(F.col("times")), 6).alias("delta")).where("delta is not null")
    ci = quantiles(per_b, [arm], "delta", [Quantile("ci95_low", 0.025), Quantile("ci95_high", 0.975)])
    seen = both.groupBy(arm).agg(difference(F.col("c")).alias("d"))
    return seen.join(ci, arm, "left").select(
        arm, F.round("d", 4).alias("precision_delta"), F.round("ci95_low", 4).alias("ci95_low"), F.round("ci95_high", 4).alias("ci95_high"),
        ((F.col("ci95_low") > 0) | (F.col("ci95_high") < 0)).alias("excludes_zero"), F.coalesce("n", F.lit(0)).alias("iterations"),
    )


def median_draws(errors: DataFrame, keys: list[str], resamples: int = MEDIAN_RESAMPLES, seed: int = 4242, digits: int = 5, width: float = 0.05) -> DataFrame:
    """Bootstrap medians per key: (keys, b, median_nm).

    `errors` has scenario_id, keys and error_nm, which is rounded. `width` is the
    bucket size of the histograms; any value gives the same result.
    """
    counts = cut_lineage(errors.groupBy(*keys, "scenario_id", F.round("error_nm", digits).alias("error_nm")).agg(F.count("*").alias("c")))
    p = cut_lineage(picks(counts.select("scenario_id").distinct(), resamples, seed))
    return resampled_medians(counts, p, keys, "scenario_id", "error_nm", width).withColumnRenamed("median", "median_nm")


def median_intervals(draws: DataFrame, keys: list[str]) -> DataFrame:
    wanted = [Quantile("ci95_low", 0.025, "linear"), Quantile("ci95_high", 0.975, "linear")]
    q = quantiles(draws, keys, "median_nm", wanted)
    return q.select(*keys, F.col("n").alias("resamples"), F.round("ci95_low", 4).alias("ci95_low"), F.round("ci95_high", 4).alias("ci95_high"))


def gap_interval(draws: DataFrame, keys: list[str], model: str, better: str, worse: str) -> DataFrame:
    """Per key, the interval of the relative improvement of one model over another, same picks."""
    a = draws.where(F.col(model) == better).select(*keys, "b", F.col("median_nm").alias("x"))
    z = draws.where(F.col(model) == worse).select(*keys, "b", F.col("median_nm").alias("y"))
    gaps = a.join(z, [*keys, "b"]).where("y > 0").select(*keys, F.round((F.col("y") - F.col("x")) / F.col("y"), 6).alias("gap"))
    q = quantiles(gaps, keys, "gap", [Quantile("ci95_low", 0.025, "linear"), Quantile("ci95_high", 0.975, "linear")])
    return q.select(
        *keys, F.lit(better).alias("model"), F.lit(worse).alias("over"), F.round("ci95_low", 4).alias("ci95_low"),
        F.round("ci95_high", 4).alias("ci95_high"), (F.col("ci95_low") > 0).alias("beats"),
    )

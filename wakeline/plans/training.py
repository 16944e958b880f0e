"""Supervised residual data sets, models and their scores."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.functions.once import computed_once
from wakeline.operators import features as ft
from wakeline.operators.bootstrap import draw, numbered
from wakeline.operators.quantiles import Quantile, quantiles
from wakeline.session import cut_lineage

# Fixed values that results depend on.
HORIZONS_S = [30.0, 60.0, 120.0]
TRAIN_SHARE, VALIDATION_SHARE = 0.6, 0.15
HUBER_WIDTH = 3.0  # of median absolute residuals; about two standard deviations
RIDGE_ALPHA = 1.0
MATERIAL_IMPROVEMENT = 0.03
MODEL_VERSION = "wakeline-residuals-v1"
SELECTION_STRATUM = "turning"
TARGETS = ["y_along", "y_cross", "y_alt"]
_ERROR_BUCKET_NM, _ERROR_BUCKET_FT = 0.01, 1.0


def dataset(updates: DataFrame, truth: DataFrame, horizon_s: float | list[float], epoch_us: int, wanted: Column | None = None) -> DataFrame:
    """One row per confirmed update with a full window and truth now and at the horizon.

    Several horizons are one pass over the updates, with a row for each. `wanted`
    says, from an update's columns and `phase`, which rows are asked for.

    Targets are the residuals of dead reckoning in the aircraft's own frame.
    `phase` is the true phase now and is only ever used for grouping.
    """
    confirmed = ft.complete(ft.with_features(updates.where("state = 'confirmed'")))
    now = F.bround((F.col("t_us") - epoch_us) / 1e6, 0).cast("int")
    spans = list(horizon_s) if isinstance(horizon_s, (list, tuple)) else [horizon_s]
    t = truth.select("scenario_id", "icao24", "sec", "phase", "lat", "lon", "altitude_ft")
    answer = t.select(
        "scenario_id", "icao24", F.col("sec").alias("answer_sec"), F.col("lat").alias("a_lat"),
        F.col("lon").alias("a_lon"), F.col("altitude_ft").alias("a_alt"),
    )
    # An update meets its own second before it becomes a row for each horizon.
    rows = confirmed.withColumn("sec", now).join(t.select("scenario_id", "icao24", "sec", "phase"), ["scenario_id", "icao24", "sec"])
    if wanted is not None:
        rows = rows.where(wanted)
    each = rows.withColumn("horizon_s", F.explode(F.array(*[F.lit(float(h)) for h in spans])))
    each = each.withColumn("answer_sec", F.col("sec") + F.round("horizon_s").cast("int"))
    labelled = each.join(answer, ["scenario_id", "icao24", "answer_sec"])
    h = F.col("horizon_s")
    based = computed_once(labelled, "base", geo.project_forward("lat", "lon", "track_deg", "ground_speed_kt", h)).withColumn(
        "base_alt", geo.dead_reckoned_altitude("altitude_ft", "vertical_rate_fpm", h)
    )
    residual = geo.along_cross_error("base.lat", "base.lon", "a_lat", "a_lon", "track_deg")
    out = computed_once(based, "res", residual)
    return out.select(
        "scenario_id", "icao24", "track_id", "t_us", "sec", "horizon_s", "phase", *ft.FEATURE_COLUMNS,
        F.col("res.along").alias("y_along"), F.col("res.cross").alias("y_cross"), (F.col("a_alt") - F.col("base_alt")).alias("y_alt"),
        F.hypot("res.along", "res.cross").alias("baseline_error_nm"),
    )


def splits(scenarios: DataFrame, shifted: Column | None = None, seed: int = 7) -> DataFrame:
    """scenario_id -> train / validation / test_same_family / test_shifted.

    A scenario falls into a split by a hash of its id, so every row of it lands
    on the same side and no global ranking is needed.
    """
    u = draw(seed, F.col("scenario_id")) / float(2**32)
    s = F.when(u < TRAIN_SHARE, "train").when(u < TRAIN_SHARE + VALIDATION_SHARE, "validation").otherwise("test_same_family")
    if shifted is not None:
        s = F.when(shifted, "test_shifted").otherwise(s)
    return scenarios.select("scenario_id", s.alias("split"))


def exact_splits(scenarios: DataFrame, shifted: Column) -> DataFrame:
    """The same shares of the scenarios of the trained family, exact to the scenario, by a dense number in hash order.

    Validation has one scenario at least. Shifted scenarios are never learned from.
    """
    marked = scenarios.select("scenario_id", F.coalesce(shifted, F.lit(False)).alias("shifted"))
    ids = numbered(marked.where("not shifted").select("scenario_id")).withColumn("one", F.lit(1))
    # One row, whatever the data: safe to broadcast.
    total = F.broadcast(ids.agg(F.count("*").alias("n"), F.lit(1).alias("one")))
    train = F.floor(F.col("n") * 60 / 100)
    val = F.greatest(F.floor(F.col("n") * 15 / 100), F.lit(1))
    own = ids.join(total, "one").select(
        "scenario_id",
        F.when(F.col("idx") < train, "train").when(F.col("idx") < train + val, "validation").otherwise("test_same_family").alias("split"),
    )
    return own.unionByName(marked.where("shifted").select("scenario_id", F.lit("test_shifted").alias("split")))


def leaks(assigned: DataFrame) -> DataFrame:
    """Scenarios that appear in more than one split; must be empty."""
    return assigned.groupBy("scenario_id").agg(F.countDistinct("split").alias("splits")).where("splits > 1")


def require_disjoint(assigned: DataFrame) -> None:
    bad = leaks(assigned).take(1)
    if bad:
        raise ValueError(f"scenario {bad[0]['scenario_id']!r} appears in more than one split")


@dataclass
class ResidualModel:
    """Three fitted regressors over standardised features."""

    name: str
    columns: list[str]
    moments: dict[str, tuple[float, float]]
    fitted: list

    def predict(self, rows: DataFrame) -> DataFrame:
        """Rows plus r_along, r_cross, r_alt; rows without a full window get nulls."""
        out = _standardised(rows, self.columns, self.moments)
        out = VectorAssembler(inputCols=[f"z_{c}" for c in self.columns], outputCol="x", handleInvalid="keep").transform(out)
        for m, target in zip(self.fitted, ("r_along", "r_cross", "r_alt")):
            out = m.setFeaturesCol("x").setPredictionCol(target).transform(out)
        keep = [F.when(F.col(self.columns[0]).isNotNull(), F.col(t)).alias(t) for t in ("r_along", "r_cross", "r_alt")]
        return out.select(*rows.columns, *keep)

    def coefficients(self) -> dict[str, dict[str, float]]:
        """Weights per standardised feature, for the linear model."""
        return {t: dict(zip(ft.FEATURES, map(float, m.coefficients))) for t, m in zip(TARGETS, self.fitted)}

    def save(self, path: str) -> None:
        """Everything that a prediction needs: regressors, feature order, moments and the version of both."""
        spark = SparkSession.active()
        for m, target in zip(self.fitted, TARGETS):
            m.write().overwrite().save(f"{path}/{target}")
        rows = [(i, c, float(mean), float(scale)) for i, c in enumerate(self.columns) for mean, scale in [self.moments[c]]]
        spark.createDataFrame(rows, "place int, feature string, mean double, scale double").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")
        # Last, so that a folder with a card holds a whole model.
        card = [(MODEL_VERSION, self.name, type(self.fitted[0]).__name__)]
        spark.createDataFrame(card, "version string, name string, kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/card")

    @classmethod
    def load(cls, path: str) -> ResidualModel:
        """A saved model; one of another version, or over other features, is refused."""
        spark = SparkSession.active()
        card = spark.read.parquet(f"{path}/card").first()
        if card["version"] != MODEL_VERSION:
            raise ValueError(f"model version {card['version']!r} is not {MODEL_VERSION!r}")
        rows = spark.read.parquet(f"{path}/features").orderBy("place").collect()
        columns = [r["feature"] for r in rows]
        if columns != list(ft.FEATURE_COLUMNS):
            raise ValueError("the model was fitted on other features")
        kind = {c.__name__: c for c in (LinearRegressionModel, GBTRegressionModel)}[card["kind"]]
        return cls(card["name"], columns, {r["feature"]: (r["mean"], r["scale"]) for r in rows}, [kind.load(f"{path}/{t}") for t in TARGETS])


def _standardised(rows: DataFrame, columns: list[str], moments: dict[str, tuple[float, float]]) -> DataFrame:
    z = [((F.col(c) - moments[c][0]) / moments[c][1]).alias(f"z_{c}") for c in columns]
    return rows.select("*", *z)


def _moments(train: DataFrame) -> tuple[dict[str, tuple[float, float]], int, dict[str, float]]:
    """One pass: feature means and scales, row count, label deviations (63 numbers)."""
    aggs = [F.avg(c).alias(f"m_{c}") for c in ft.FEATURE_COLUMNS] + [F.stddev_pop(c).alias(f"s_{c}") for c in ft.FEATURE_COLUMNS]
    aggs += [F.stddev_pop(y).alias(f"s_{y}") for y in TARGETS] + [F.count("*").alias("n")]
    row = train.agg(*aggs).first()
    m = {c: (row[f"m_{c}"], row[f"s_{c}"] if row[f"s_{c}"] >= 1e-9 else 1.0) for c in ft.FEATURE_COLUMNS}
    return m, row["n"], {y: row[f"s_{y}"] for y in TARGETS}


def fit_ridge(train: DataFrame, alpha: float = RIDGE_ALPHA) -> ResidualModel:
    """Least squares with an L2 penalty on standardised features, intercept free.

    MLlib scales the label internally and averages the loss over rows; both are
    undone in the penalty so that it equals `alpha` on the plain sum of squares.
    """
    moments, n, label_std = _moments(train)
    x = VectorAssembler(inputCols=[f"z_{c}" for c in ft.FEATURE_COLUMNS], outputCol="x")
    data = x.transform(_standardised(train, ft.FEATURE_COLUMNS, moments)).select("x", *TARGETS)
    fitted = [
        LinearRegression(
            featuresCol="x", labelCol=y, solver="normal", regParam=alpha / n * (label_std[y] or 1.0), elasticNetParam=0.0,
            standardization=False,
        ).fit(data)
        for y in TARGETS
    ]
    return ResidualModel("ridge", list(ft.FEATURE_COLUMNS), moments, fitted)


@dataclass
class LinearModel:
    """Least squares over standardised features, as an expression of them."""

    name: str
    columns: list[str]
    moments: dict[str, tuple[float, float]]
    intercepts: list[float]
    weights: np.ndarray  # targets x features

    def predict(self, rows: DataFrame) -> DataFrame:
        """Rows plus r_along, r_cross, r_alt; rows without a full window get nulls."""
        z = [(F.col(c) - m) / s for c, (m, s) in ((c, self.moments[c]) for c in self.columns)]
        return rows.select("*", *[
            functools.reduce(lambda a, b: a + b, (zi * float(w) for zi, w in zip(z, weights)), F.lit(b0)).alias(name)
            for name, b0, weights in zip(("r_along", "r_cross", "r_alt"), self.intercepts, self.weights)
        ])

    def coefficients(self) -> dict[str, dict[str, float]]:
        """Weights per standardised feature."""
        return {t: dict(zip(ft.FEATURES, map(float, w))) for t, w in zip(TARGETS, self.weights)}


def normal_equations(train: DataFrame, moments: dict[str, tuple[float, float]], means: list[float]) -> np.ndarray:
    """Sums of products of standardised features and centred targets, features first.

    One pass: tasks multiply their batches, and only 23 x 23 numbers a task are shuffled.
    """
    names, size = [*ft.FEATURE_COLUMNS, *TARGETS], len(ft.FEATURE_COLUMNS) + len(TARGETS)
    shift = np.array([moments[c][0] for c in ft.FEATURE_COLUMNS] + means)
    scale = np.array([moments[c][1] for c in ft.FEATURE_COLUMNS] + [1.0] * len(TARGETS))

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            z = (np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in names], 1).astype(np.float64) - shift) / scale
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], ["place", "v"])

    rows = train.select(*names).mapInArrow(products, "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size * size)
    for r in rows:
        out[r["place"]] = r["v"]
    return out.reshape(size, size)


def fit_linear(train: DataFrame, alpha: float = RIDGE_ALPHA) -> LinearModel:
    """Ridge regression solved exactly: minimises the plain sum of squares plus `alpha` on the weights, intercept free."""
    moments, _, _ = _moments(train)
    means = list(train.agg(*[F.avg(y) for y in TARGETS]).first())
    sums, k = normal_equations(train, moments, means), len(ft.FEATURE_COLUMNS)
    weights = np.linalg.solve(sums[:k, :k] + alpha * np.eye(k), sums[:k, k:]).T
    return LinearModel("ridge", list(ft.FEATURE_COLUMNS), moments, [float(m) for m in means], weights)


def fit_boosted(train: DataFrame, validation: DataFrame | None = None, rounds: int = 40, depth: int = 4, robust: bool = True) -> ResidualModel:
    """The non-linear challenger: gradient-boosted trees per target.

    Boosting stops when another tree no longer helps on `validation`; without
    validation rows it runs all rounds. `robust` fits twice: rows whose residual
    from the first fit exceeds HUBER_WIDTH typical residuals count in inverse
    proportion to it in the second, so squared loss acts as Huber's.
    """
    moments, _, _ = _moments(train)
    x = VectorAssembler(inputCols=[f"z_{c}" for c in ft.FEATURE_COLUMNS], outputCol="x")

    def assembled(rows: DataFrame, held: bool) -> DataFrame:
        return x.transform(_standardised(rows, ft.FEATURE_COLUMNS, moments)).select("x", *TARGETS, F.lit(held).alias("held"))

    data = assembled(train, False)
    stops = validation is not None and not validation.isEmpty()
    if stops:
        data = data.unionByName(assembled(validation, True))
    data = cut_lineage(data)

    def fit(rows: DataFrame, y: str, **more: str) -> GBTRegressionModel:
        if stops:
            more["validationIndicatorCol"] = "held"
        return GBTRegressor(featuresCol="x", labelCol=y, maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=11, **more).fit(rows)

    fitted = []
    for y in TARGETS:
        m = fit(data, y)
        if robust:
            off = m.transform(data).withColumn("off", F.abs(F.col("prediction") - F.col(y))).drop("prediction")
            typical = off.where("not held").agg(F.percentile_approx("off", 0.5, 1000)).first()[0] or 0.0
            limit = F.lit(HUBER_WIDTH * typical)
            if typical > 0:
                m = fit(off.withColumn("weight", F.least(F.lit(1.0), limit / F.greatest("off", limit))), y, weightCol="weight")
        fitted.append(m)
    return ResidualModel("boosted", list(ft.FEATURE_COLUMNS), moments, fitted)


def zero_residuals(rows: DataFrame) -> DataFrame:
    """Dead reckoning through the same path as a model."""
    return rows.select("*", *[F.lit(0.0).alias(c) for c in ("r_along", "r_cross", "r_alt")])


def physics_residuals(rows: DataFrame, kind: str) -> DataFrame:
    """`persistence`, `dead_reckoning` or `constant_turn` as residual columns."""
    if kind == "dead_reckoning":
        return zero_residuals(rows)
    if kind == "persistence":
        r = geo.persistence_residual("f_ground_speed_kt", "f_vertical_rate_fpm", "horizon_s")
    else:
        r = geo.constant_turn_residual("f_ground_speed_kt", "f_turn_rate_deg_s", "horizon_s")
    return computed_once(rows, "_r", r).select(
        *rows.columns, F.col("_r.along").alias("r_along"), F.col("_r.cross").alias("r_cross"), F.col("_r.alt").alias("r_alt")
    )


def scored(rows: DataFrame, name: str, *more: str) -> DataFrame:
    """Residual rows reduced to what scoring needs, and the columns `more`."""
    return rows.select(
        *more, F.lit(name).alias("model"), "scenario_id", "horizon_s", "phase", "baseline_error_nm",
        F.hypot(F.col("y_along") - F.col("r_along"), F.col("y_cross") - F.col("r_cross")).alias("error_nm"),
        F.abs(F.col("y_alt") - F.col("r_alt")).alias("altitude_error_ft"),
    )


def with_strata(rows: DataFrame) -> DataFrame:
    """Every row once in `all` and once in the stratum of its true phase."""
    own = (
        F.when(F.col("phase") == "cruise", "cruise")
        .when(F.col("phase") == "turn", "turning")
        .when(F.col("phase").isin("climb", "descent"), "climbing_or_descending")
    )
    member = F.filter(F.array(F.lit("all"), own), lambda s: s.isNotNull())
    return rows.withColumn("stratum", F.explode(member))


def score_table(rows: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Error statistics per (model, stratum, horizon), with skill against the same stratum's baseline."""
    keys = [*(extra or []), "horizon_s", "model", "stratum"]
    each = with_strata(rows)
    base = each.groupBy(*keys).agg(F.count("*").alias("samples"), F.avg("error_nm").alias("mean_nm"))
    err = quantiles(each, keys, "error_nm", [Quantile("median_nm", 0.5, "median"), Quantile("p90_nm", 0.9, "linear")], width=_ERROR_BUCKET_NM).drop("n")
    alt = quantiles(each, keys, "altitude_error_ft", [Quantile("median_altitude_ft", 0.5, "median")], width=_ERROR_BUCKET_FT).drop("n")
    ref = quantiles(each, keys, "baseline_error_nm", [Quantile("baseline_nm", 0.5, "median")], width=_ERROR_BUCKET_NM).drop("n")
    j = base.join(err, keys).join(alt, keys).join(ref, keys)
    skill = F.when(F.col("baseline_nm") > 0, (F.col("baseline_nm") - F.col("median_nm")) / F.col("baseline_nm")).otherwise(0.0)
    return j.select(
        *keys, F.round("median_nm", 4).alias("median_nm"), F.round("p90_nm", 4).alias("p90_nm"), F.round("mean_nm", 4).alias("mean_nm"),
        F.round("median_altitude_ft", 1).alias("median_altitude_ft"), F.round(skill, 4).alias("skill"), "samples",
    )


def turning_medians(rows: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Of `score_table`, what `winner` and `calibration` read: the medians in turns and how many samples they have."""
    keys = [*(extra or []), "horizon_s", "model"]
    turns = rows.where("phase = 'turn'")
    n = turns.groupBy(*keys).agg(F.count("*").alias("samples"))
    err = quantiles(turns, keys, "error_nm", [Quantile("median_nm", 0.5, "median")], width=_ERROR_BUCKET_NM).drop("n")
    return n.join(err, keys).select(*keys, F.lit(SELECTION_STRATUM).alias("stratum"), F.round("median_nm", 4).alias("median_nm"), "samples")


def winner(validation_scores: DataFrame, simple: str = "ridge", challenger: str = "boosted") -> DataFrame:
    """Per horizon, the challenger only if it beats the simple model materially on the turning stratum."""
    t = validation_scores.where(F.col("stratum") == SELECTION_STRATUM)
    pick = t.groupBy("horizon_s").agg(
        F.max(F.when(F.col("model") == simple, F.col("median_nm"))).alias("simple_nm"),
        F.max(F.when(F.col("model") == challenger, F.col("median_nm"))).alias("challenger_nm"),
    )
    gain = F.when(F.col("simple_nm") > 0, (F.col("simple_nm") - F.col("challenger_nm")) / F.col("simple_nm")).otherwise(0.0)
    return pick.withColumn("improvement", F.round(gain, 4)).withColumn(
        "winner", F.when(gain >= MATERIAL_IMPROVEMENT, challenger).otherwise(simple)
    )


def calibration(test_scores: DataFrame, winners: DataFrame) -> DataFrame:
    """Typical error per horizon and source, from the turning stratum of a held-out split."""
    t = test_scores.where(F.col("stratum") == SELECTION_STRATUM).select("horizon_s", "model", "median_nm", "samples")
    best = t.join(winners.select("horizon_s", F.col("winner").alias("model")), ["horizon_s", "model"]).select(
        F.lit("model").alias("source"), "horizon_s", F.col("median_nm").alias("typical_nm"), "samples"
    )
    physics = t.where("model = 'dead_reckoning'").select(
        F.lit("dead_reckoning").alias("source"), "horizon_s", F.col("median_nm").alias("typical_nm"), "samples"
    )
    return best.unionByName(physics)


def round_trip(rows: DataFrame) -> DataFrame:
    """Worst disagreement after applying and re-measuring each residual at a fixed place."""
    lat, lon, hdg = F.lit(40.0), F.lit(-75.0), F.lit(90.0)
    base = geo.project_forward(lat, lon, hdg, "f_ground_speed_kt", "horizon_s")
    moved = geo.apply_along_cross("base.lat", "base.lon", "r_along", "r_cross", hdg)
    back = geo.along_cross_error("base.lat", "base.lon", "moved.lat", "moved.lon", hdg)
    r = computed_once(computed_once(computed_once(rows, "base", base), "moved", moved), "back", back)
    worst = F.max(F.greatest(F.abs(F.col("back.along") - F.col("r_along")), F.abs(F.col("back.cross") - F.col("r_cross"))))
    return r.groupBy("horizon_s").agg(F.count("*").alias("rows"), worst.alias("worst_nm"))

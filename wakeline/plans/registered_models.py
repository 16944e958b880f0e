"""Registered queries over training data, models and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.operators import bootstrap, conformance, features, scoring, telemetry, tracking
from wakeline.plans import evaluation, training
from wakeline.plans.registered import EPOCH, evaluation_inputs, query, rnd, scenario_table, updates
from wakeline.session import cut_lineage
from wakeline.sources import traffic

FC = features.FEATURE_COLUMNS


def dataset(spark, sf, horizon_s=60.0):
    return training.dataset(updates(spark, sf, lifecycle=False), traffic.truth(spark, sf), horizon_s, EPOCH)


def split_of(spark, sf):
    s = scenario_table(spark, sf)
    return training.splits(s, shifted=F.col("family") == "shifted")


@query("f01_window_features")
def f01(spark, sf):
    f = features.complete(features.with_features(updates(spark, sf, lifecycle=False)))
    return rnd(f.select("scenario_id", "track_id", "t_us", *FC), 4, *FC)


@query("d10_residual_labels")
def d10(spark, sf):
    d = dataset(spark, sf)
    return rnd(d.select("scenario_id", "track_id", "t_us", "phase", *training.TARGETS, "baseline_error_nm"), 4, *training.TARGETS, "baseline_error_nm")


@query("k01_dataset")
def k01(spark, sf):
    return dataset(spark, sf, training.HORIZONS_S).groupBy("horizon_s", "phase").agg(
        F.count("*").alias("samples"), F.countDistinct("scenario_id").alias("scenarios"), F.round(F.avg("baseline_error_nm"), 4).alias("mean_nm"))


@query("k02_splits")
def k02(spark, sf):
    return split_of(spark, sf)


@query("k02_exact_splits")
def k02_exact(spark, sf):
    """The split that models are fitted and scored by."""
    return training.exact_splits(scenario_table(spark, sf), F.col("family") == "shifted")


@query("d13_split_leaks")
def d13(spark, sf):
    """Leaks of a deliberately careless split by aircraft instead of by scenario."""
    t = traffic.truth(spark, sf).select("scenario_id", "icao24").distinct()
    careless = t.select("scenario_id", F.when(bootstrap.draw(3, F.col("icao24")) / float(2**32) < 0.9, "train").otherwise("test").alias("split"))
    return training.leaks(careless)


@query("e13_standardiser")
def e13(spark, sf):
    f = features.complete(features.with_features(updates(spark, sf, lifecycle=False)))
    return rnd(features.standardiser(f), 5, "mean", "scale")


@query("e14_feature_profile")
def e14(spark, sf):
    f = features.complete(features.with_features(updates(spark, sf, lifecycle=False)))
    return rnd(features.describe(f), 4, "mean", "std", "min", "max")


def _physics_scores(spark, sf, kinds=("persistence", "dead_reckoning", "constant_turn"), wanted=None):
    """Errors of physics; features that no kind reads are not worked out."""
    d = training.dataset(updates(spark, sf, lifecycle=False), traffic.truth(spark, sf), training.HORIZONS_S, EPOCH, wanted)
    read = [f"f_{n}" for n in ("ground_speed_kt", "vertical_rate_fpm", "turn_rate_deg_s")]
    d = cut_lineage(d.select("scenario_id", "horizon_s", "phase", *read, *training.TARGETS, "baseline_error_nm"))
    out = None
    for kind in kinds:
        s = training.scored(training.physics_residuals(d, kind), kind)
        out = s if out is None else out.unionByName(s)
    return out


@query("e10_scores_by_stratum")
def e10(spark, sf):
    return training.score_table(cut_lineage(_physics_scores(spark, sf)))


@query("k04_zero_model")
def k04(spark, sf):
    s = training.scored(training.zero_residuals(dataset(spark, sf)), "dead_reckoning")
    return s.groupBy("scenario_id").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("error_nm") - F.col("baseline_error_nm")) < 1e-9).alias("same"))


@query("k08_strata")
def k08(spark, sf):
    return training.with_strata(dataset(spark, sf)).groupBy("stratum").agg(F.count("*").alias("samples"))


@query("k09_round_trip")
def k09(spark, sf):
    r = training.round_trip(training.physics_residuals(dataset(spark, sf), "constant_turn"))
    return r.select("horizon_s", "rows", (F.col("worst_nm") < 1e-6).alias("exact"))


@query("k06_predictions_with_fallback")
def k06(spark, sf):
    """Physics-arc residuals stand in for a model: full windows use them, the rest dead-reckons."""
    f = features.with_features(updates(spark, sf, lifecycle=False))
    r = geo.constant_turn_residual("f_ground_speed_kt", "f_turn_rate_deg_s", 60.0)
    odd = F.when(F.abs("f_turn_rate_deg_s") > 1.0, float("nan")).otherwise(r["along"])
    m = f.withColumn("r_along", odd).withColumn("r_cross", r["cross"]).withColumn("r_alt", F.when(F.col(FC[0]).isNotNull(), 0.0))
    p = conformance.predictions(m)
    return rnd(p.select("scenario_id", "track_id", "t_us", "source", "p_lat", "p_lon", "p_altitude_ft"), 6, "p_lat", "p_lon", "p_altitude_ft")


def _median_draws(spark, sf):
    s = _physics_scores(spark, sf, ("dead_reckoning", "constant_turn"), F.col("phase") == "turn").withColumn("error_nm", F.round("error_nm", 4))
    return cut_lineage(bootstrap.median_draws(s, ["horizon_s", "model"], digits=4))


@query("e11_median_bootstrap")
def e11(spark, sf):
    return bootstrap.median_intervals(_median_draws(spark, sf), ["horizon_s", "model"])


@query("e11_gap_bootstrap")
def e11_gap(spark, sf):
    return bootstrap.gap_interval(_median_draws(spark, sf), ["horizon_s"], "model", "constant_turn", "dead_reckoning")


HELD_OUT = ["validation", "test_same_family", "test_shifted"]
FITS = {"ridge": lambda train, validation: training.fit_linear(train), "boosted": training.fit_boosted}


def _assigned(spark, sf, horizons=training.HORIZONS_S, splits=None, turns_of=(), updated=None):
    """The data set with its splits, kept for the several fits that read it.

    What is not read is not worked out: only the asked `horizons` and scenarios of the asked `splits`, and of splits in
    `turns_of` only rows in turns. No row depends on the others.
    """
    assigned = training.exact_splits(scenario_table(spark, sf), F.col("family") == "shifted")
    training.require_disjoint(assigned)
    if splits is not None:
        assigned = assigned.where(F.col("split").isin(splits))
    assigned = cut_lineage(assigned)

    def asked(rows):
        return rows.join(assigned.select("scenario_id"), "scenario_id", "left_semi")

    if updated is None:
        updated = tracking.track_updates(asked(traffic.reports(spark, sf)), as_of_us=traffic.end_of_data(spark, sf), lifecycle=False)
    wanted = None if not turns_of else ~F.col("split").isin(*turns_of) | (F.col("phase") == "turn")
    d = training.dataset(updated.join(assigned, "scenario_id"), asked(traffic.truth(spark, sf)), horizons, EPOCH, wanted)
    return cut_lineage(d.join(assigned, "scenario_id"))


def _held_out_errors(d, rows, names):
    """Errors of each named model and dead reckoning on rows of the data set; a model is fitted for each horizon."""
    out = training.scored(training.zero_residuals(rows), "dead_reckoning", "split")
    for h in training.HORIZONS_S:
        at = F.col("horizon_s") == h
        train, validation = (d.where(F.col("split") == s).where(at) for s in ("train", "validation"))
        for n in names:
            out = out.unionByName(training.scored(FITS[n](train, validation).predict(rows.where(at)), n, "split"))
    return cut_lineage(out)


def _held_out_scores(spark, sf, names):
    """Scores of each named model and dead reckoning by split and horizon."""
    d = _assigned(spark, sf)
    return training.score_table(_held_out_errors(d, d.where(F.col("split").isin(HELD_OUT)), names), ["split"])


@query("k03_ridge_scores")
def k03(spark, sf):
    return _held_out_scores(spark, sf, ["ridge"])


@query("k03_ridge_coefficients")
def k03_coefficients(spark, sf):
    """Weights of the standardised features for each horizon and target, and the intercept."""
    d = _assigned(spark, sf).where("split = 'train'")
    rows = []
    for h in training.HORIZONS_S:
        m = training.fit_linear(d.where(F.col("horizon_s") == h))
        for target, b0 in zip(training.TARGETS, m.intercepts):
            rows += [(h, target, "intercept", b0), *((h, target, f, w) for f, w in m.coefficients()[target].items())]
    return rnd(spark.createDataFrame(rows, "horizon_s double, target string, feature string, weight double"), 4, "weight")


def _served(spark, sf, updated=None):
    """The model fitted for 60 s, and typical errors of its predictions and of dead reckoning in turns of the same family."""
    # Typical errors are those of turns.
    d = _assigned(spark, sf, [conformance.HORIZON_S], ["train", "test_same_family"], ["test_same_family"], updated)
    m = training.fit_linear(d.where("split = 'train'"))
    test = d.where("split = 'test_same_family'")
    errors = training.scored(training.zero_residuals(test), "dead_reckoning").unionByName(training.scored(m.predict(test), m.name))
    chosen = spark.createDataFrame([(conformance.HORIZON_S, m.name)], "horizon_s double, winner string")
    return m, cut_lineage(training.calibration(training.turning_medians(cut_lineage(errors)), chosen))


def _fitted(spark, sf):
    """Updates, worked out once, and the model of 60 s fitted to them."""
    u = cut_lineage(updates(spark, sf, lifecycle=False))
    return u, training.fit_linear(_assigned(spark, sf, [conformance.HORIZON_S], ["train"], updated=u))


def _model_predictions(model, updated):
    return conformance.predictions(model.predict(features.with_features(updated)))


@query("e15_served_calibration")
def e15_served(spark, sf):
    return _served(spark, sf)[1]


@query("e02_fitted_deviations")
def e02_fitted(spark, sf):
    """Worst deviations from the fitted model, and from dead reckoning where it falls back, beyond their fitted thresholds."""
    u = cut_lineage(updates(spark, sf, lifecycle=False))
    m, calibration = _served(spark, sf, u)
    found = conformance.deviations(conformance.matured(_model_predictions(m, u)), calibration=calibration)
    return rnd(found.select("scenario_id", "track_id", "matched_us", "predicted_us", "source", "error_nm", "baseline_error_nm", "threshold_nm"), 3, "error_nm", "baseline_error_nm", "threshold_nm")


@query("k12_fitted_evaluation")
def k12_fitted(spark, sf):
    """k12 with the fitted model and its fitted thresholds in the chain."""
    s, _, sc = evaluation_inputs(spark, sf)
    m, calibration = _served(spark, sf, s.updates)
    out = evaluation.conformance_evaluation(s, traffic.manoeuvres(spark, sf), sc, EPOCH, _model_predictions(m, s.updates), calibration)[1]
    return scoring.recall_by(out.join(sc.select("scenario_id", "family"), "scenario_id"), "family", "kind")


@query("k06_fitted_predictions")
def k06_fitted(spark, sf):
    """Where the fitted model of 60 s, with its fallback, puts each update; the source says which was used."""
    u, m = _fitted(spark, sf)
    p = _model_predictions(m, u)
    return rnd(p.select("scenario_id", "track_id", "t_us", "source", "p_lat", "p_lon", "p_altitude_ft"), 4, "p_lat", "p_lon").withColumn("p_altitude_ft", F.round("p_altitude_ft", 1) + 0.0)


@query("e16_predictions_by_source")
def e16_predictions(spark, sf):
    """Predictions made each minute, by what made them."""
    u, m = _fitted(spark, sf)
    return telemetry.counters(_model_predictions(m, u), "t_us", "scenario_id", "source")


@query("k05_boosted_scores")
def k05(spark, sf):
    return _held_out_scores(spark, sf, ["boosted"]).where("model = 'boosted'")


def _contest(spark, sf, splits):
    """Medians in turns of both models and dead reckoning, a table for each of the splits; models stop on all of validation."""
    d = _assigned(spark, sf, splits=["train", *splits], turns_of=[s for s in splits if s != HELD_OUT[0]])
    errors = _held_out_errors(d, d.where(F.col("split").isin(splits) & (F.col("phase") == "turn")), list(FITS))
    scores = cut_lineage(training.turning_medians(errors, ["split"]))
    return tuple(scores.where(F.col("split") == s).drop("split") for s in splits)


@query("k07_winner")
def k07(spark, sf):
    return training.winner(_contest(spark, sf, HELD_OUT[:1])[0])


@query("e15_calibration")
def e15(spark, sf):
    """Typical errors on the same family, as served, and on the shifted one."""
    validation, same, shifted = _contest(spark, sf, HELD_OUT)
    best = training.winner(validation)
    tables = [training.calibration(t, best).withColumn("split", F.lit(s)) for t, s in ((same, HELD_OUT[1]), (shifted, HELD_OUT[2]))]
    return tables[0].unionByName(tables[1])

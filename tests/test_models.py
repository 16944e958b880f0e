"""A fitted model kept, served and judged: split, fit, save, load, predict, calibrate, check."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import conformance, features
from wakeline.plans import training
from wakeline.plans.registered import EPOCH, scenario_table, updates
from wakeline.session import cut_lineage
from wakeline.sources import traffic

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def flown(spark):
    return cut_lineage(updates(spark, SF, lifecycle=False))


@pytest.fixture(scope="module")
def rows(spark, flown):
    splits = training.exact_splits(scenario_table(spark, SF), F.col("family") == "shifted")
    training.require_disjoint(splits)
    return cut_lineage(training.dataset(flown, traffic.truth(spark, SF), [30.0, 60.0], EPOCH).join(splits, "scenario_id"))


@pytest.fixture(scope="module")
def ridge(rows):
    return training.fit_ridge(rows.where("split = 'train' and horizon_s = 60"))


def test_horizons_in_one_pass(spark, flown, rows):
    alone = training.dataset(flown, traffic.truth(spark, SF), 30.0, EPOCH)
    both = rows.where("horizon_s = 30").select(*alone.columns)
    assert alone.count() == both.count() > 0 and alone.exceptAll(both).count() == 0


def test_shifted_scenarios_are_never_learned_from(rows):
    found = {(r["family"], r["split"]) for r in rows.join(scenario_table(rows.sparkSession, SF), "scenario_id").select("family", "split").distinct().collect()}
    assert {s for f, s in found if f == "shifted"} == {"test_shifted"}
    assert {s for f, s in found if f == "nominal"} == {"train", "validation", "test_same_family"}


def test_saved_model_predicts_the_same(spark, rows, ridge, tmp_path):
    ridge.save(f"{tmp_path}/ridge")
    again = training.ResidualModel.load(f"{tmp_path}/ridge")
    test = rows.where("split = 'test_shifted' and horizon_s = 60")
    keys = ["track_id", "t_us", "r_along", "r_cross", "r_alt"]
    a, b = ridge.predict(test).select(*keys), again.predict(test).select(*keys)
    assert a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_other_versions_are_refused(spark, ridge, tmp_path):
    ridge.save(f"{tmp_path}/old")
    spark.createDataFrame([("other", "ridge", "LinearRegressionModel")], "version string, name string, kind string").write.mode("overwrite").parquet(f"{tmp_path}/old/card")
    with pytest.raises(ValueError, match="version"):
        training.ResidualModel.load(f"{tmp_path}/old")


def test_fitted_model_in_the_conformance_chain(flown, rows, ridge):
    """Full windows are predicted by the model, the rest by physics; the model's thresholds come from its own calibration."""
    served = ridge.predict(features.with_features(flown))
    predicted = cut_lineage(conformance.predictions(served))
    checked = cut_lineage(conformance.matured(predicted))
    errors = {r["source"]: r for r in checked.groupBy("source").agg(F.count("*").alias("n"), F.avg("error_nm").alias("own"), F.avg("baseline_error_nm").alias("base")).collect()}
    assert set(errors) == {"model", "dead_reckoning"}
    assert errors["dead_reckoning"]["own"] == pytest.approx(errors["dead_reckoning"]["base"])
    assert abs(errors["model"]["own"] - errors["model"]["base"]) > 1e-3
    test = rows.where("split = 'test_same_family' and horizon_s = 60")
    scores = training.score_table(cut_lineage(training.scored(training.zero_residuals(test), "dead_reckoning").unionByName(training.scored(ridge.predict(test), "ridge"))))
    winners = scores.sparkSession.createDataFrame([(60.0, "ridge")], "horizon_s double, winner string")
    calibration = cut_lineage(training.calibration(scores, winners))
    typical = {r["source"]: r["typical_nm"] for r in calibration.collect()}
    assert set(typical) == {"model", "dead_reckoning"}
    # Where it was fitted, the model is the better of the two in the mean square.
    own = F.avg(F.col("error_nm") ** 2).alias("own")
    fitted = training.scored(ridge.predict(rows.where("split = 'train' and horizon_s = 60")), "ridge").agg(own, F.avg(F.col("baseline_error_nm") ** 2).alias("base")).first()
    assert fitted["own"] < fitted["base"]
    found = conformance.deviations(checked, calibration=calibration)
    want = {s: max(conformance.THRESHOLD_FLOOR_NM, t * conformance.THRESHOLD_FACTOR) for s, t in typical.items()}
    got = found.select("source", "threshold_nm", "error_nm").collect()
    assert all(r["threshold_nm"] == pytest.approx(want[r["source"]]) and r["error_nm"] > r["threshold_nm"] for r in got)
    over = sum(1 for r in checked.select("source", "error_nm").collect() if r["error_nm"] > want[r["source"]])
    assert 0 < len(got) <= over


def test_registered_scores_span_horizons_and_held_out_splits(spark, sf):
    from wakeline.plans import registered_models as rm

    keys = ["horizon_s", "model", "stratum"]
    found = cut_lineage(rm.k03(spark, sf))
    assert {(r["split"], r["horizon_s"], r["model"]) for r in found.collect()} == {
        (s, h, m) for s in ("validation", "test_same_family", "test_shifted") for h in training.HORIZONS_S for m in ("ridge", "dead_reckoning")}
    # One horizon fitted and scored by itself.
    splits = training.exact_splits(scenario_table(spark, sf), F.col("family") == "shifted")
    d = cut_lineage(rm.dataset(spark, sf, 60.0).join(splits, "scenario_id"))
    test = d.where("split = 'test_same_family'")
    alone = training.score_table(cut_lineage(training.scored(training.fit_linear(d.where("split = 'train'")).predict(test), "ridge")))
    one = found.where("split = 'test_same_family' and horizon_s = 60 and model = 'ridge'")
    want, got = ({tuple(r[k] for k in keys): (r["samples"], r["median_nm"], r["skill"]) for r in t.collect()} for t in (alone, one))
    assert want and set(want) == set(got) and all(got[k] == pytest.approx(want[k], abs=2e-4) for k in want)


def test_ridge_is_solved_exactly(spark, rows):
    """Weights that minimise the plain sum of squares plus alpha, from the collected rows; MLlib's come within its scaling of alpha."""
    train = rows.where("split = 'train' and horizon_s = 60")
    m, data = training.fit_linear(train), train.toPandas()
    x = np.array([(data[c] - m.moments[c][0]) / m.moments[c][1] for c in m.columns]).T
    y = data[training.TARGETS].to_numpy()
    want = np.linalg.solve(x.T @ x + np.eye(x.shape[1]), x.T @ (y - y.mean(0)))
    assert np.allclose(m.weights, want.T, rtol=1e-7, atol=1e-8) and np.allclose(m.intercepts, y.mean(0))
    mllib = training.fit_ridge(train).coefficients()
    for t, own in m.coefficients().items():
        scale = max(map(abs, own.values()))
        assert all(abs(own[f] - mllib[t][f]) < 1e-2 * scale for f in own)
    predicted = m.predict(rows).where("r_along is not null").limit(50).toPandas()
    z = np.array([(predicted[c] - m.moments[c][0]) / m.moments[c][1] for c in m.columns]).T
    assert np.allclose(predicted[["r_along", "r_cross", "r_alt"]].to_numpy(), z @ m.weights.T + m.intercepts)


def test_boosting_stops_on_validation_and_bears_outliers(spark):
    rng = np.random.default_rng(5)

    def table(n, outliers):
        x = rng.normal(size=(n, 20))
        y = np.stack([np.where(x[:, 0] > 0, 1.0, -1.0) + 0.05 * rng.normal(size=n)] * 3, 1)
        y[rng.random(n) < outliers] += 60.0
        return spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(x, y)], [*features.FEATURE_COLUMNS, *training.TARGETS])

    train, validation, test = table(1500, 0.03), table(500, 0.03), table(400, 0.0)
    robust = training.fit_boosted(train, validation, rounds=60, depth=2)
    assert all(m.getNumTrees < 60 for m in robust.fitted)

    def error(m):
        return m.predict(test).agg(F.avg(F.abs(F.col("r_along") - F.col(training.TARGETS[0])))).first()[0]

    assert error(robust) < 0.8 * error(training.fit_boosted(train, validation, rounds=60, depth=2, robust=False))
    assert training.fit_boosted(train, validation.limit(0), rounds=2, depth=1).predict(test).count() == 400

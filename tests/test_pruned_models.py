"""Model queries work out only what they read (F32 to F40)."""

import pytest

from wakeline.plans import registered_models, training
from wakeline.plans.registered import QUERIES, load_all

load_all()


@pytest.fixture
def kept(monkeypatch):
    """Data sets that the queries keep, in place of a fit or a score."""
    seen = []
    original = registered_models._assigned

    def noted(*args, **kwargs):
        seen.append(original(*args, **kwargs))
        return seen[-1]

    monkeypatch.setattr(registered_models, "_assigned", noted)
    return seen


SF01 = "/root/testdata/sf0.01"


def test_a_served_model_keeps_one_horizon_and_the_scenarios_it_reads(spark, kept):
    QUERIES["k06_fitted_predictions"](spark, SF01)
    QUERIES["e15_served_calibration"](spark, SF01)
    for d, splits in zip(kept, (["train"], ["test_same_family", "train"])):
        assert [r[0] for r in d.select("horizon_s").distinct().collect()] == [60.0]
        assert sorted(r[0] for r in d.select("split").distinct().collect()) == splits
    assert kept[1].where("split <> 'train' and phase <> 'turn'").isEmpty()
    whole = registered_models.dataset(spark, SF01).join(kept[0].select("scenario_id").distinct(), "scenario_id")
    assert kept[0].drop("split").select(*whole.columns).exceptAll(whole).isEmpty() and kept[0].count() == whole.count()


def test_turning_medians_are_those_of_the_score_table(spark):
    rows = spark.createDataFrame(
        [(p, m, h, "s", 1.0, 0.01 * (i * 37 % 101), 5.0, ph) for i in range(120) for p, m, h, ph in [("v", "ridge", 30.0, "turn" if i % 3 else "cruise"), ("t", "dead_reckoning", 60.0, "turn")]],
        "split string, model string, horizon_s double, scenario_id string, baseline_error_nm double, error_nm double, altitude_error_ft double, phase string",
    )
    names = ["split", "horizon_s", "model", "stratum", "median_nm", "samples"]
    wanted = training.score_table(rows, ["split"]).where("stratum = 'turning'").select(*names)
    assert sorted(training.turning_medians(rows, ["split"]).select(*names).collect()) == sorted(wanted.collect())


def test_median_draws_keep_errors_in_turns_alone(spark, sf, monkeypatch):
    seen = []
    original = registered_models.cut_lineage
    monkeypatch.setattr(registered_models, "cut_lineage", lambda d: seen.append(original(d)) or seen[-1])
    registered_models._median_draws(spark, sf)
    assert "f_turn_rate_std" not in seen[0].columns and seen[0].where("phase <> 'turn'").isEmpty() and len(seen[0].columns) == 10

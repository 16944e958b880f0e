"""The constant turn of whole batches (F32)."""

import pytest
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.plans.registered import QUERIES, load_all

load_all()


def test_turns_of_batches_equal_the_expression(spark):
    rows = spark.createDataFrame(
        [(40.0, -75.0, 10.0, 450.0, 3.0), (40.0, 179.99, 90.0, 500.0, -1.5), (-33.0, 10.0, 359.9, 400.0, 0.0), (89.9, 0.0, 0.0, 480.0, 1e-7), (10.0, 20.0, 30.0, 0.0, 2.0),
         (None, 1.0, 2.0, 300.0, 1.0), (1.0, None, 2.0, 300.0, 1.0), (1.0, 2.0, None, 300.0, 1.0), (1.0, 2.0, 3.0, None, 1.0), (1.0, 2.0, 3.0, 300.0, None)],
        "lat double, lon double, t double, v double, r double",
    )
    both = rows.select(geo.constant_turn("lat", "lon", "t", "v", "r", 60.0).alias("a"), geo.constant_turn_of("lat", "lon", "t", "v", "r", F.lit(60.0)).alias("b"))
    for a, b in both.collect():
        # Without a rate of turn the expression has a struct of nulls, too.
        for x, y in zip(a, b):
            assert (x is None) == (y is None) and (x is None or y == pytest.approx(x, abs=1e-10))


def test_constant_turn_is_not_interpreted_leg_by_leg(spark, sf):
    plan = QUERIES["b11_constant_turn"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "constant_turn_of" in plan

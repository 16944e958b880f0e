import pytest
from pyspark.sql import functions as F

from wakeline.functions import geo, sql

ROWS = [(40.0, -75.0, 41.0, -74.0, 350.0, 420.0), (0.0, 179.9, 0.1, -179.9, 90.0, 300.0), (10.0, 10.0, 10.0, 10.0, 0.0, 0.0), (-33.0, 151.0, -34.5, 150.0, 181.5, 455.0)]
CASES = {
    "initial_bearing(a, b, c, d)": lambda: geo.initial_bearing("a", "b", "c", "d"),
    "haversine_nm(a, b, c, d)": lambda: geo.haversine_nm("a", "b", "c", "d"),
    "destination_point(a, b, t, 37.5D)": lambda: geo.destination_point("a", "b", "t", 37.5),
    "to_local_enu(a, b, c, d)": lambda: geo.to_local_enu("a", "b", "c", "d"),
    "from_local_enu(a, b, c, d)": lambda: geo.from_local_enu("a", "b", "c", "d"),
    "project_forward(a, b, t, v, 60.0D)": lambda: geo.project_forward("a", "b", "t", "v", 60.0),
    "dead_reckoned_altitude(c, -v, 60.0D)": lambda: geo.dead_reckoned_altitude("c", -F.col("v"), 60.0),
    "constant_turn_residual(v, 3.0D, 60.0D)": lambda: geo.constant_turn_residual("v", F.lit(3.0), 60.0),
    "persistence_residual(v, d, 60.0D)": lambda: geo.persistence_residual("v", "d", 60.0),
    "along_cross_error(a, b, c, d, t)": lambda: geo.along_cross_error("a", "b", "c", "d", "t"),
    "snapped_origin(a, b)": lambda: geo.snapped_origin("a", "b"),
    "normalize_bearing(d - t)": lambda: geo.normalize_bearing(F.col("d") - F.col("t")),
    "bearing_difference(t, d)": lambda: geo.bearing_difference("t", "d"),
    "flight_phase(d * 10, a)": lambda: geo.flight_phase(F.col("d") * 10, "a"),
}


@pytest.mark.parametrize("call", CASES)
def test_sql_function_equals_the_column_expression(spark, call):
    sql.register(spark)
    df = spark.createDataFrame(ROWS, "a double, b double, c double, d double, t double, v double")
    for row in df.select(F.expr(call).alias("x"), CASES[call]().alias("y")).collect():
        x, y = (tuple(v) if isinstance(v, tuple) else (v,) for v in (row["x"], row["y"]))
        assert x == pytest.approx(y, abs=1e-9) if not isinstance(x[0], str) else x == y

"""Keep expensive expressions from being copied by the optimizer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is evaluated once per row, however often it is used.

    Adjacent projections are collapsed, and a long expression used in several
    places is then copied into each of them until the generated code outgrows
    what the JVM compiles. A one-element generator stays in code generation and
    is a boundary for that copying.
    """
    return df.withColumn(name, F.explode(F.array(value)))

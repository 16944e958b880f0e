"""Time slices with halos: windows per key that no hot key can overload.

A window over one key sorts that key in one task. Most look-arounds here are
bounded in time, so the key is cut into slices of event time and every row is
also copied into the neighbouring slices that need it as context. Windows then
partition by (key, slice), a hot key spreads over its slices, and dropping the
copies afterwards gives exactly the unsliced answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE_S = 3600.0


def with_halo(df: DataFrame, *, t_us: str = "t_us", before_s: float = 0.0, after_s: float = 0.0,
              slice_s: float = SLICE_S) -> DataFrame:
    """Add `slice` and `core`; rows within `before_s`/`after_s` of a slice are copied into it.

    `before_s` is how far back a row of a slice may look, `after_s` how far ahead.
    """
    size = int(slice_s * 1e6)
    t = F.col(t_us)
    own = F.floor(t / size)
    first = F.floor((t - int(after_s * 1e6)) / size)
    last = F.floor((t + int(before_s * 1e6)) / size)
    return df.withColumn("slice", F.explode(F.sequence(first, last))).withColumn("core", F.col("slice") == own)


def sliced_window(*keys: str, t_us: str = "t_us"):
    return Window.partitionBy(*keys, "slice").orderBy(t_us)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where("core").drop("slice", "core")

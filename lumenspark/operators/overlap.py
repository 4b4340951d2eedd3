"""Area resampling between grids of one window, as an interval join that lists the overlaps instead of searching them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resample_axis(samples: DataFrame, group: list[str], place: str, value: str, source: int, target: int) -> DataFrame:
    """(group, cell, value): the mean of the source cells over each target cell, by the lengths of their overlaps.

    Both grids divide one window. A source cell meets the target cells from floor(i t / s) to ceil((i + 1) t / s) - 1,
    so overlaps are generated, in whole units of 1 / (s t) of the window, and summed; equal grids come out unchanged.
    """
    i = F.col(place).cast("bigint")
    first, last = F.floor(i * target / F.lit(source)), F.ceil((i + 1) * target / F.lit(source)) - 1
    met = samples.select(*group, F.col(value).alias("_v"), i.alias("_i"), F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))).alias("cell"))
    low, high = F.greatest(F.col("_i") * target, F.col("cell") * source), F.least((F.col("_i") + 1) * target, (F.col("cell") + 1) * source)
    met = met.withColumn("_share", (high - low) / F.lit(source)).where("_share > 0")
    return met.groupBy(*group, "cell").agg(F.sum(F.col("_v") * F.col("_share")).alias("value"))


def resample(samples: DataFrame, group: list[str], y: str, x: str, value: str, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """(group, y, x, value) on the target grid, one axis after the other."""
    rows = resample_axis(samples, [*group, x], y, value, source[0], target[0]).withColumnRenamed("cell", "_y")
    made = resample_axis(rows, [*group, "_y"], x, "value", source[1], target[1])
    return made.select(*group, F.col("_y").alias("y"), F.col("cell").alias("x"), "value")


def spatial_integral(samples: DataFrame, group: list[str], value: str, area: float) -> DataFrame:
    return samples.groupBy(*group).agg((F.sum(value) * area).alias("integral"))

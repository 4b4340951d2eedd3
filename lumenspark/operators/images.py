"""Measures of sampled images given as rows (id, y, x, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def difference(pairs: DataFrame, group: list[str], reference: str, candidate: str, data_range: float | None = None) -> DataFrame:
    """(group, mse, rmse, mae, mean_error, max_abs_error, psnr_db, data_range, samples) of aligned samples.

    Without a range, it is the span of the reference, which must not be 0 (then it and the ratio are null). The ratio of
    no error is infinite.
    """
    error = F.col(candidate) - F.col(reference)
    sums = pairs.groupBy(*group).agg(
        F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.avg(error).alias("mean_error"), F.max(F.abs(error)).alias("max_abs_error"), (F.max(reference) - F.min(reference)).alias("_span"), F.count(F.lit(1)).alias("samples")
    )
    span = F.lit(data_range) if data_range is not None else F.when(F.col("_span") > 0, F.col("_span"))
    rmse = F.sqrt("mse")
    ratio = F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(20 * F.log10(F.try_divide(span, rmse)))
    return sums.select(*group, "mse", rmse.alias("rmse"), "mae", "mean_error", "max_abs_error", F.when(span.isNotNull(), ratio).alias("psnr_db"), span.alias("data_range"), "samples")


def centred(samples: DataFrame, group: list[str], y: str, x: str, value: str) -> DataFrame:
    """Adds ``mass``, the value over its sum, and ``dy``, ``dx``, doubled distances from the grid's middle, whole numbers."""
    whole = Window.partitionBy(*group)
    return (
        samples.withColumn("mass", F.try_divide(F.col(value), F.sum(value).over(whole)))
        .withColumn("dy", 2 * F.col(y) - F.max(y).over(whole) - F.min(y).over(whole))
        .withColumn("dx", 2 * F.col(x) - F.max(x).over(whole) - F.min(x).over(whole))
    )


def encircled_energy(samples: DataFrame, group: list[str], y: str, x: str, value: str, spacing: float = 1.0) -> DataFrame:
    """(group, radius, energy): the share within each radius from the middle. Rings are told apart by whole numbers,
    the squares of doubled distances, so equal radii are never split."""
    rings = centred(samples, group, y, x, value).withColumn("_ring", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    rings = rings.groupBy(*group, "_ring").agg(F.sum("mass").alias("_mass"))
    line = Window.partitionBy(*group).orderBy("_ring").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("_mass").over(Window.partitionBy(*group))
    return rings.select(*group, (F.sqrt(F.col("_ring").cast("double")) / 2 * spacing).alias("radius"), (F.sum("_mass").over(line) / total).alias("energy"))


def point_source(samples: DataFrame, group: list[str], y: str, x: str, value: str, spacing: float = 1.0) -> DataFrame:
    """(group, total, centroid_x, centroid_y, rms_radius, peak) about the grid's middle."""
    m, dx, dy = F.col("mass"), F.col("dx") / 2 * spacing, F.col("dy") / 2 * spacing
    sums = centred(samples, group, y, x, value).groupBy(*group).agg(F.sum(value).alias("total"), F.sum(m * dx).alias("centroid_x"), F.sum(m * dy).alias("centroid_y"), F.sum(m * (dx * dx + dy * dy)).alias("_second"), F.max("mass").alias("peak"))
    spread = F.col("_second") - F.col("centroid_x") ** 2 - F.col("centroid_y") ** 2
    return sums.select(*group, "total", "centroid_x", "centroid_y", F.sqrt(F.greatest(spread, F.lit(0.0))).alias("rms_radius"), "peak")


def symmetry(samples: DataFrame, group: list[str], y: str, x: str, value: str) -> DataFrame:
    """(group, horizontal, vertical, transpose): the largest difference from each flip; the grid must be square."""
    whole = Window.partitionBy(*group)
    flips = samples.withColumn("_x", F.max(x).over(whole) + F.min(x).over(whole) - F.col(x)).withColumn("_y", F.max(y).over(whole) + F.min(y).over(whole) - F.col(y))
    # two samples meet in each of these keys, so a window of two does for a self-join
    out = flips
    for name, a in (("horizontal", (y, F.least(x, "_x"))), ("vertical", (x, F.least(y, "_y"))), ("transpose", (F.least(y, x), F.greatest(y, x)))):
        pair = Window.partitionBy(*group, *a)
        out = out.withColumn(name, F.max(value).over(pair) - F.min(value).over(pair))
    return out.groupBy(*group).agg(*[F.max(n).alias(n) for n in ("horizontal", "vertical", "transpose")])

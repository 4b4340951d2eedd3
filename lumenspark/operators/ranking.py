"""Precision and recall along a ranked list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Fixed value: the spacing of doubles at 1, which keeps precision finite.
EPSILON = 2.220446049250313e-16


def precision_recall(ranked: DataFrame, group: list[str], order: list[Column], relevant: str) -> DataFrame:
    """Adds ``n``, ``tp``, ``recall``, ``precision`` and the right-to-left maximum ``envelope``.

    ``relevant`` holds 0 or 1. A group without relevant rows has null recall. Shuffles once, on ``group``.
    """
    down = Window.partitionBy(*group).orderBy(*order)
    seen = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*group)
    rest = down.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        ranked.withColumn("n", F.count(F.lit(1)).over(seen))
        .withColumn("tp", F.sum(F.col(relevant).cast("double")).over(seen))
        .withColumn("positives", F.sum(F.col(relevant).cast("double")).over(whole))
        .withColumn("recall", F.try_divide(F.col("tp"), F.col("positives")))
        .withColumn("precision", F.col("tp") / (F.col("n") + F.lit(EPSILON)))
        .withColumn("envelope", F.max("precision").over(rest))
    )


def average_precision(curve: DataFrame, group: list[str], points: int = 101) -> DataFrame:
    """The mean, over ``points`` recall levels, of the envelope at the first rank that reaches the level.

    A level that is never reached counts 0; a group without positives gets the sentinel -1. A row answers
    for the levels above the previous row's recall up to its own, so nothing is joined or repeated.
    """
    before = F.coalesce(F.lag("recall").over(Window.partitionBy(*group).orderBy("n")), F.lit(-1.0))
    levels = levels_between(F.col("before"), F.col("recall"), points)
    return (
        curve.withColumn("before", before)
        .withColumn("answers", levels)
        .groupBy(*group)
        .agg(
            F.when(F.max("positives") > 0, F.sum(F.col("answers") * F.col("envelope")) / points).otherwise(F.lit(-1.0)).alias("ap"),
            F.max("positives").cast("bigint").alias("positives"),
            F.count(F.lit(1)).alias("ranked"),
        )
    )


def levels_between(low: Column, high: Column, levels: int = 101) -> Column:
    """How many of the recall levels k / (levels - 1) are above ``low`` and not above ``high``."""
    step, last = 1.0 / (levels - 1), levels - 1

    def upto(x: Column) -> Column:
        k = F.floor(x * last)  # may be one off either way, for k * step is rounded
        k = k + F.when((k + 1) * F.lit(step) <= x, 1).otherwise(0) - F.when(k * F.lit(step) > x, 1).otherwise(0)
        return F.least(F.greatest(k + 1, F.lit(0)), F.lit(levels))

    return upto(high) - upto(low)

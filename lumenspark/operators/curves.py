"""Ordered curves: crossings, integrals, lookups, spectra. A curve is rows (id, order, x, y) with x ascending."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trapezoid(curve: DataFrame, group: list[str], order: list[str], x: str, y: str, name: str = "area") -> DataFrame:
    """The trapezoid sum of each curve; a single point has none."""
    line = Window.partitionBy(*group).orderBy(*order)
    piece = (F.col(y) + F.lag(y).over(line)) / 2 * (F.col(x) - F.lag(x).over(line))
    return curve.withColumn("_piece", piece).groupBy(*group).agg(F.coalesce(F.sum("_piece"), F.lit(0.0)).alias(name))


def downward_crossing(curve: DataFrame, group: list[str], order: list[str], x: str, y: str, level: float) -> DataFrame:
    """(group, crossing, censoring): where the curve first falls to ``level``, between its points.

    Censoring is 'left' for a curve that starts at or below the level, 'right' for one that never falls to it, else null.
    """
    line = Window.partitionBy(*group).orderBy(*order)
    y0, x0 = F.lag(y).over(line), F.lag(x).over(line)
    at = F.when((y0 > level) & (F.col(y) <= level), x0 + (level - y0) / (F.col(y) - y0) * (F.col(x) - x0))
    marked = curve.withColumn("_n", F.row_number().over(line)).withColumn("_at", at)
    found = marked.groupBy(*group).agg(F.min_by("_at", F.when(F.col("_at").isNotNull(), F.col("_n"))).alias("_at"), F.min_by(y, "_n").alias("_y"))
    start = F.col("_y") <= level
    return found.select(*group, F.when(~start, F.col("_at")).alias("crossing"), F.when(start, "left").when(F.col("_at").isNull(), "right").alias("censoring"))


def radius_at(curve: DataFrame, group: list[str], radius: str, energy: str, fraction: float, interpolate: bool = False) -> DataFrame:
    """The first radius whose energy reaches the fraction, or the point on the way to it."""
    line = Window.partitionBy(*group).orderBy(radius)
    e0, r0 = F.lag(energy).over(line), F.lag(radius).over(line)
    here = F.col(radius)
    if interpolate:
        here = F.when(e0.isNull() | (F.col(energy) == e0), here).otherwise(r0 + (fraction - e0) / (F.col(energy) - e0) * (F.col(radius) - r0))
    last = F.max(radius).over(Window.partitionBy(*group))
    marked = curve.withColumn("_here", here).withColumn("_met", (F.col(energy) >= fraction) | (F.col(radius) == last))
    return marked.where("_met").groupBy(*group).agg(F.min_by("_here", radius).alias("radius"))


def envelope(curve: DataFrame, group: list[str], order: list[str], y: str) -> DataFrame:
    """Adds ``envelope``, the running maximum from the right."""
    line = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return curve.withColumn("envelope", F.max(y).over(line))


def interpolated(points: DataFrame, at: str, curve: DataFrame, x: str, y: str, key: str | None = None) -> DataFrame:
    """``points`` with ``value``, the curve's linear interpolation at ``at``; ends are held beyond them.

    An as-of lookup without a join on ranges: points and curve are put in one order, and each point takes the last
    curve point before it and the first one after. With a key, curves are looked up by it and the order is dealt by it;
    without one there is one curve, of POINTS points at most.
    """
    names = points.columns
    if key is None:
        return _by_array(points, at, curve, x, y)
    tagged = points.select(F.struct(*names).alias("_row"), F.col(key).alias("_key"), F.col(at).cast("double").alias("_at"), F.lit(None).cast("double").alias("_y"), F.lit(1).alias("_kind"))
    nodes = curve.select(F.lit(None).cast(tagged.schema["_row"].dataType).alias("_row"), F.col(key).alias("_key"), F.col(x).cast("double").alias("_at"), F.col(y).cast("double").alias("_y"), F.lit(0).alias("_kind"))
    node = F.when(F.col("_kind") == 0, F.struct(F.col("_at").alias("x"), F.col("_y").alias("y")))
    line = Window.partitionBy("_key").orderBy("_at", "_kind")
    before = F.last(node, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(node, ignorenulls=True).over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    both = tagged.unionByName(nodes).withColumn("_a", before).withColumn("_b", after).where("_kind = 1")
    return both.select("_row.*", _between("_a", "_b").alias("value"))


def _between(a: str, b: str) -> Column:
    """On the line from node a to node b at ``_at``; a missing node is held."""
    ax, ay, bx, by = F.col(f"{a}.x"), F.col(f"{a}.y"), F.col(f"{b}.x"), F.col(f"{b}.y")
    return F.when(F.col(a).isNull(), by).when(F.col(b).isNull() | (ax == bx), ay).otherwise(ay + (by - ay) / (bx - ax) * (F.col("_at") - ax))


#: Points of a curve without a key: it is taken to the driver and into the plan as a constant.
POINTS = 1 << 14


def _by_array(points: DataFrame, at: str, curve: DataFrame, x: str, y: str) -> DataFrame:
    """The curve as a constant array that each point searches by halving."""
    rows = sorted((float(r[0]), float(r[1])) for r in curve.select(x, y).limit(POINTS + 1).collect())
    if not rows or len(rows) > POINTS:
        raise ValueError(f"a curve without a key has 1 to {POINTS} points")
    steps = len(rows).bit_length()
    xs, ys = (F.split(F.lit(",".join(map(repr, v))), ",").cast("array<double>") for v in zip(*rows, strict=True))
    padded = F.concat(xs, F.array_repeat(F.lit(float("inf")), (1 << steps) - len(rows)))
    halves = F.array(*[F.lit(1 << s) for s in reversed(range(steps))])
    place = F.aggregate(halves, F.lit(0), lambda low, step: F.when(F.element_at(padded, low + step) <= F.col("_at"), low + step).otherwise(low))

    def node(k: Column) -> Column:
        return F.when((k >= 1) & (k <= len(rows)), F.struct(F.try_element_at(xs, k).alias("x"), F.try_element_at(ys, k).alias("y")))

    marked = points.withColumn("_at", F.col(at).cast("double")).withColumn("_k", F.least(place, F.lit(len(rows))))
    marked = marked.withColumn("_a", node(F.greatest("_k", F.lit(1)))).withColumn("_b", node(F.least(F.col("_k") + 1, F.lit(len(rows)))))
    held = F.when(F.col("_k") == 0, F.col("_b.y")).otherwise(_between("_a", "_b"))
    return marked.select(*points.columns, F.when(F.col("_at").isNotNull(), held).alias("value"))


def gradient(curve: DataFrame, group: list[str], order: list[str], y: str, spacing: float = 1.0) -> DataFrame:
    """Adds ``slope``: central differences, one-sided at the ends."""
    line = Window.partitionBy(*group).orderBy(*order)
    before, after = F.lag(y).over(line), F.lead(y).over(line)
    slope = F.when(before.isNull(), (after - F.col(y)) / spacing).when(after.isNull(), (F.col(y) - before) / spacing).otherwise((after - before) / (2 * spacing))
    return curve.withColumn("slope", slope)


def axis_response(samples: DataFrame, group: list[str], place: str, value: str, frequencies: list[float]) -> DataFrame:
    """(group, frequency, magnitude): the magnitude of the transform of each row of samples, 1 at frequency 0."""
    waves = samples.withColumn("frequency", F.explode(F.array(*map(F.lit, frequencies))))
    angle = -2 * math.pi * F.col("frequency") * F.col(place)
    sums = waves.groupBy(*group, "frequency").agg(F.sum(F.col(value) * F.cos(angle)).alias("_re"), F.sum(F.col(value) * F.sin(angle)).alias("_im"), F.sum(value).alias("_dc"))
    return sums.select(*group, "frequency", F.try_divide(F.sqrt(F.col("_re") ** 2 + F.col("_im") ** 2), F.abs("_dc")).alias("magnitude"))


def edge_spread(samples: DataFrame, group: list[str], position: str, value: str, bins: int) -> DataFrame:
    """(group, bin, centre, value): means in equal bins from the least position to the greatest; empty bins are filled
    by the line between the nearest full ones."""
    whole = samples.groupBy(*group).agg(F.min(position).alias("_low"), F.max(position).alias("_high"))
    every = whole.select(*group, "_low", "_high", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    every = every.withColumn("centre", F.col("_low") + (F.col("bin") + 0.5) * (F.col("_high") - F.col("_low")) / bins)
    placed = samples.join(whole, group)
    place = F.floor((F.col(position) - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins).cast("int")
    means = placed.withColumn("bin", F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1))).groupBy(*group, "bin").agg(F.avg(value).alias("_mean"))
    joined = every.join(means, [*group, "bin"], "left")
    node = F.when(F.col("_mean").isNotNull(), F.struct(F.col("centre").alias("x"), F.col("_mean").alias("y")))
    line = Window.partitionBy(*group).orderBy("bin")
    before = F.last(node, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(node, ignorenulls=True).over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    filled = joined.withColumn("_at", F.col("centre")).withColumn("_a", before).withColumn("_b", after)
    return filled.select(*group, "bin", "centre", _between("_a", "_b").alias("value"))


def line_fit(samples: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """(group, slope, intercept, angle in degrees) of the least-squares line."""
    fit = samples.groupBy(*group).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    return fit.withColumn("angle", F.degrees(F.atan(F.abs("slope"))))

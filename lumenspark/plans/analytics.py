"""Queries on curves, intervals, images, grids and selections over the driver tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenspark.operators import curves, images, intervals, overlap, selection
from lumenspark.sources.tables import table


def _rounded(frame: DataFrame, *names: str, digits: int = 7) -> DataFrame:
    return frame.withColumns({n: F.round(n, digits) for n in names})


def _user_events(spark: SparkSession, folder: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9)
    return table(spark, folder, "events").select("user_id", "event_id", (t - 473352).alias("hours"), F.col("value"), "event_type")


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector as an 8 x 8 image."""
    rows = table(spark, folder, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "e"))
    return rows.select("vec_id", "label", "i", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.col("e").cast("double").alias("e"))


def trapezoid_auc(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(curves.trapezoid(_user_events(spark, folder), ["user_id"], ["hours", "event_id"], "hours", "value"), "area", digits=5)


def first_downward_crossing(spark: SparkSession, folder: str) -> DataFrame:
    v = _vectors(spark, folder)
    line = Window.partitionBy("vec_id").orderBy(F.desc("m"), "i")
    whole = Window.partitionBy("vec_id")
    curve = v.withColumn("m", F.abs("e")).withColumn("n", F.row_number().over(line).cast("double")).withColumn("mtf", F.col("m") / F.max("m").over(whole))
    made = curves.downward_crossing(curve.where("vec_id % 5 <> 0 or n < 4"), ["vec_id"], ["n"], "n", "mtf", 0.5)
    return _rounded(made, "crossing")


def percentile_interval(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    made = intervals.percentile_interval(rows, ["l_returnflag"], "l_extendedprice")
    return _rounded(made, "lower", "upper", digits=4)


def normal_half_width(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    return _rounded(rows.groupBy("l_returnflag", "l_linestatus").agg(intervals.half_width("l_extendedprice").alias("half_width")), "half_width", digits=4)


def paired_difference_ratio(spark: SparkSession, folder: str) -> DataFrame:
    means = table(spark, folder, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_quantity").alias("value"))
    return _rounded(intervals.paired(means, "l_returnflag", ["l_suppkey"], "value", "A"), "value", "difference", "ratio")


def curve_contrast(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").groupBy("l_suppkey", "l_linenumber")
    arms = rows.agg(F.avg(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))).alias("p"), F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("c")).where("p is not null and c is not null")
    return _rounded(intervals.curve_contrast(arms, ["l_suppkey"], "l_linenumber", "p", "c"), "auc", digits=6)


def hierarchical_mean(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").withColumn("v", F.when(F.col("event_id") % 4 == 0, F.lit(-1.0)).otherwise(F.col("value")))
    return _rounded(rows.groupBy("event_type").agg(intervals.mean_defined("v").alias("mean"), F.count(F.lit(1)).alias("n")), "mean")


def image_difference(spark: SparkSession, folder: str) -> DataFrame:
    v = _vectors(spark, folder).select("vec_id", "i", "e")
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), "i", F.col("e").alias("f")), ["vec_id", "i"])
    made = images.difference(pairs, ["vec_id"], "e", "f")
    return _rounded(made, "mse", "rmse", "mae", "mean_error", "max_abs_error", "psnr_db", "data_range")


def encircled_energy(spark: SparkSession, folder: str) -> DataFrame:
    v = _vectors(spark, folder).withColumn("p", F.col("e") * F.col("e"))
    return _rounded(images.encircled_energy(v, ["vec_id"], "y", "x", "p"), "radius", "energy")


def energy_radius(spark: SparkSession, folder: str) -> DataFrame:
    v = _vectors(spark, folder).withColumn("p", F.col("e") * F.col("e"))
    curve = images.encircled_energy(v, ["vec_id"], "y", "x", "p")
    made = curves.radius_at(curve, ["vec_id"], "radius", "energy", 0.8).withColumnRenamed("radius", "ee80")
    return _rounded(made.join(curves.radius_at(curve, ["vec_id"], "radius", "energy", 0.5, interpolate=True).withColumnRenamed("radius", "ee50"), "vec_id"), "ee80", "ee50")


def point_source_moments(spark: SparkSession, folder: str) -> DataFrame:
    v = _vectors(spark, folder).withColumn("p", F.col("e") * F.col("e"))
    return _rounded(images.point_source(v, ["vec_id"], "y", "x", "p"), "total", "centroid_x", "centroid_y", "rms_radius", "peak")


def symmetry(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(images.symmetry(_vectors(spark, folder), ["vec_id"], "y", "x", "e"), "horizontal", "vertical", "transpose")


def area_resample(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(overlap.resample_axis(_vectors(spark, folder), ["vec_id"], "i", "e", 64, 24), "value")


def area_resample_2d(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(overlap.resample(_vectors(spark, folder), ["vec_id"], "y", "x", "e", (8, 8), (3, 5)), "value")


def spatial_integral(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(overlap.spatial_integral(_vectors(spark, folder), ["vec_id"], "e", 4e-2), "integral")


def esf_bins(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").withColumn("q", F.pow("l_quantity", F.lit(3.0)))
    return _rounded(curves.edge_spread(rows, ["l_returnflag"], "q", "l_extendedprice", 37), "centre", "value", digits=4)


def edge_line(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(curves.line_fit(table(spark, folder, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount"), "slope", "intercept", "angle")


def kernel_axis_mtf(spark: SparkSession, folder: str) -> DataFrame:
    v = _vectors(spark, folder).groupBy("vec_id", "x").agg(F.sum(F.col("e") * F.col("e")).alias("p"))
    return _rounded(curves.axis_response(v, ["vec_id"], "x", "p", [0.0, 0.125, 0.25, 0.5]), "magnitude")


def curve_gradient(spark: SparkSession, folder: str) -> DataFrame:
    v = _vectors(spark, folder).select("vec_id", "i", "e")
    return _rounded(curves.gradient(v, ["vec_id"], ["i"], "e").select("vec_id", "i", "slope"), "slope")


def interp_lookup(spark: SparkSession, folder: str) -> DataFrame:
    curve = table(spark, folder, "nation").select((F.col("n_nationkey") * 9.5).alias("x"), F.sqrt("n_nationkey").alias("y"))
    return _rounded(curves.interpolated(table(spark, folder, "events").select("event_id", "value").withColumnRenamed("value", "at"), "at", curve, "x", "y"), "value")


def interp_lookup_keyed(spark: SparkSession, folder: str) -> DataFrame:
    curve = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("k"), F.dayofyear("o_orderdate").alias("d")).agg(F.ln(F.max("o_totalprice")).alias("p"))
    points = table(spark, folder, "customer").select("c_custkey", F.col("c_custkey").alias("k"), (F.col("c_nationkey") * 14).alias("at"))
    return _rounded(curves.interpolated(points, "at", curve, "d", "p", "k").select("c_custkey", "value"), "value")


def selection_offset_limit(spark: SparkSession, folder: str) -> DataFrame:
    return selection.offset_limit(table(spark, folder, "documents").select("doc_id", "lang", "n_chars"), "doc_id", 37, 25)


def topk_100_cap(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return selection.top_per_group(rows, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5)


def filter_before_limit(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").where("o_orderstatus <> 'P'").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return selection.top_per_group(rows, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 1)


def shard_partition(spark: SparkSession, folder: str) -> DataFrame:
    return selection.numbered_partitions(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", 250)


def merge_coverage(spark: SparkSession, folder: str) -> DataFrame:
    expected = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
    items = table(spark, folder, "lineitem").where("l_linenumber = 1 or l_orderkey % 97 = 0")
    pieces = items.select(F.when(F.col("l_orderkey") % 89 == 0, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("id"), (F.col("l_orderkey") % 7).alias("piece"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"))
    return selection.merge_coverage(expected, pieces, "id", "piece", "n").groupBy("problem", "id").agg(F.count(F.lit(1)).alias("times"))


def iou_pairs(spark: SparkSession, folder: str) -> DataFrame:
    from lumenspark.functions.geometry import iou

    b = table(spark, folder, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("x1"), (F.col("l_discount") * 100).alias("y1"), (F.col("l_quantity") + 10 + F.col("l_linenumber")).alias("x2"), (F.col("l_discount") * 100 + F.col("l_tax") * 100 + 1).alias("y2")).distinct()
    # boxes meet in the grid cells that they share, a pair in the first of them
    cell = {c: F.floor(F.col(c) / size).cast("bigint") for c, size in zip(selection.BOX, (16, 4, 16, 4), strict=True)}
    b = b.withColumn("gx", F.explode(F.sequence(cell["x1"], cell["x2"]))).withColumn("gy", F.explode(F.sequence(cell["y1"], cell["y2"])))
    other = b.select("l_suppkey", "gx", "gy", F.col("id").alias("other"), *[F.col(c).alias(f"b{c}") for c in selection.BOX])
    first = [F.floor(F.greatest(c, f"b{c}") / size) == F.col(g) for c, size, g in (("x1", 16, "gx"), ("y1", 4, "gy"))]
    pairs = b.join(other, ["l_suppkey", "gx", "gy"]).where("id < other").where(first[0] & first[1])
    value = iou(tuple(F.col(c) for c in selection.BOX), tuple(F.col(f"b{c}") for c in selection.BOX))
    return _rounded(pairs.select("l_suppkey", "id", "other", value.alias("iou")).where("iou > 0"), "iou")


QUERIES = {
    f.__name__: f
    for f in (
        trapezoid_auc, first_downward_crossing, percentile_interval, normal_half_width, paired_difference_ratio, curve_contrast, hierarchical_mean, image_difference, encircled_energy, energy_radius, point_source_moments, symmetry,
        area_resample, area_resample_2d, spatial_integral, esf_bins, edge_line, kernel_axis_mtf, curve_gradient, interp_lookup, interp_lookup_keyed, selection_offset_limit, topk_100_cap, filter_before_limit, shard_partition, merge_coverage, iou_pairs,
    )
}

_V = "SELECT vec_id, label, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings"
_P = f"v0 AS ({_V}), v AS (SELECT *, (i // 8)::INTEGER AS y, (i % 8)::INTEGER AS x, e * e AS p FROM v0)"
_EE = f"""{_P}, m AS (SELECT vec_id, (2 * x - 7) * (2 * x - 7) + (2 * y - 7) * (2 * y - 7) AS ring, p / sum(p) OVER (PARTITION BY vec_id) AS m FROM v),
r AS (SELECT vec_id, ring, sum(m) AS m FROM m GROUP BY ALL), c AS (SELECT vec_id, sqrt(ring) / 2 AS radius, sum(m) OVER (PARTITION BY vec_id ORDER BY ring) / sum(m) OVER (PARTITION BY vec_id) AS energy FROM r)"""
_W = "[0.0::DOUBLE, 0.125::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE]"

ORACLE_SQL = {
    "trapezoid_auc": """WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 3.6e9::DOUBLE - 473352 AS h, value FROM events),
p AS (SELECT user_id, (value + lag(value) OVER w) / 2 * (h - lag(h) OVER w) AS a FROM e WINDOW w AS (PARTITION BY user_id ORDER BY h, event_id)) SELECT user_id, round(coalesce(sum(a), 0.0::DOUBLE), 5) AS area FROM p GROUP BY user_id""",
    "first_downward_crossing": f"""WITH v AS ({_V}), m AS (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY abs(e) DESC, i)::DOUBLE AS n, abs(e) / max(abs(e)) OVER (PARTITION BY vec_id) AS y FROM v),
f AS (SELECT * FROM m WHERE vec_id % 5 <> 0 OR n < 4), l AS (SELECT *, lag(y) OVER w AS y0, lag(n) OVER w AS n0 FROM f WINDOW w AS (PARTITION BY vec_id ORDER BY n)),
c AS (SELECT vec_id, n, n0 + (0.5::DOUBLE - y0) / (y - y0) * (n - n0) AS cr FROM l WHERE y0 > 0.5::DOUBLE AND y <= 0.5::DOUBLE), a AS (SELECT vec_id, arg_min(cr, n) AS cr FROM c GROUP BY vec_id), s AS (SELECT DISTINCT vec_id FROM f)
SELECT s.vec_id, round(cr, 7) AS crossing, CASE WHEN cr IS NULL THEN 'right' END AS censoring FROM s LEFT JOIN a USING (vec_id)""",
    "percentile_interval": "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.025::DOUBLE), 4) AS lower, round(quantile_cont(l_extendedprice, 0.975::DOUBLE), 4) AS upper FROM lineitem GROUP BY l_returnflag",
    "normal_half_width": "SELECT l_returnflag, l_linestatus, round(1.96::DOUBLE * stddev_samp(l_extendedprice), 4) AS half_width FROM lineitem GROUP BY ALL",
    "paired_difference_ratio": """WITH m AS (SELECT l_returnflag, l_suppkey, avg(l_quantity) AS value FROM lineitem GROUP BY ALL), b AS (SELECT l_suppkey, value AS base FROM m WHERE l_returnflag = 'A')
SELECT l_returnflag, l_suppkey, round(value, 7) AS value, round(value - base, 7) AS difference, round(CASE WHEN base > 0 THEN value / base END, 7) AS ratio FROM m LEFT JOIN b USING (l_suppkey)""",
    "curve_contrast": """WITH a AS (SELECT l_suppkey, l_linenumber AS n, avg(l_quantity) FILTER (WHERE l_returnflag = 'A') - avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS g FROM lineitem GROUP BY ALL HAVING g IS NOT NULL),
p AS (SELECT l_suppkey, (g + lag(g) OVER w) / 2 * (n - lag(n) OVER w) AS a FROM a WINDOW w AS (PARTITION BY l_suppkey ORDER BY n)) SELECT l_suppkey, round(coalesce(sum(a), 0.0::DOUBLE), 6) AS auc FROM p GROUP BY l_suppkey""",
    "hierarchical_mean": "SELECT event_type, round(coalesce(avg(value) FILTER (WHERE event_id % 4 <> 0 AND value >= 0), -1.0::DOUBLE), 7) AS mean, count(*)::BIGINT AS n FROM events GROUP BY event_type",
    "image_difference": f"""WITH v AS ({_V}), p AS (SELECT a.vec_id, a.e AS r, b.e - a.e AS d FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 AND a.i = b.i),
s AS (SELECT vec_id, avg(d * d) AS mse, avg(abs(d)) AS mae, avg(d) AS me, max(abs(d)) AS top, max(r) - min(r) AS span, count(*)::BIGINT AS samples FROM p GROUP BY vec_id)
SELECT vec_id, round(mse, 7) AS mse, round(sqrt(mse), 7) AS rmse, round(mae, 7) AS mae, round(me, 7) AS mean_error, round(top, 7) AS max_abs_error,
  CASE WHEN mse = 0 THEN 'inf'::DOUBLE ELSE round(20 * log10(span / sqrt(CASE WHEN mse = 0 THEN 1 ELSE mse END)), 7) END AS psnr_db, round(span, 7) AS data_range, samples FROM s""",
    "encircled_energy": f"WITH {_EE} SELECT vec_id, round(radius, 7) AS radius, round(energy, 7) AS energy FROM c",
    "energy_radius": f"""WITH {_EE}, l AS (SELECT *, lag(energy) OVER w AS e0, lag(radius) OVER w AS r0, max(radius) OVER (PARTITION BY vec_id) AS top FROM c WINDOW w AS (PARTITION BY vec_id ORDER BY radius)),
a AS (SELECT vec_id, min(radius) AS ee80 FROM l WHERE energy >= 0.8::DOUBLE OR radius = top GROUP BY vec_id),
b AS (SELECT vec_id, arg_min(CASE WHEN e0 IS NULL OR energy = e0 THEN radius ELSE r0 + (0.5::DOUBLE - e0) / (energy - e0) * (radius - r0) END, radius) AS ee50 FROM l WHERE energy >= 0.5::DOUBLE OR radius = top GROUP BY vec_id)
SELECT vec_id, round(ee80, 7) AS ee80, round(ee50, 7) AS ee50 FROM a JOIN b USING (vec_id)""",
    "point_source_moments": f"""WITH {_P}, m AS (SELECT vec_id, p, (2 * x - 7) / 2::DOUBLE AS x, (2 * y - 7) / 2::DOUBLE AS y, p / sum(p) OVER (PARTITION BY vec_id) AS m FROM v),
s AS (SELECT vec_id, sum(p) AS total, sum(m * x) AS cx, sum(m * y) AS cy, sum(m * (x * x + y * y)) AS s2, max(m) AS peak FROM m GROUP BY vec_id)
SELECT vec_id, round(total, 7) AS total, round(cx, 7) AS centroid_x, round(cy, 7) AS centroid_y, round(sqrt(greatest(s2 - cx * cx - cy * cy, 0)), 7) AS rms_radius, round(peak, 7) AS peak FROM s""",
    "symmetry": f"""WITH {_P} SELECT a.vec_id, round(max(abs(a.e - h.e)), 7) AS horizontal, round(max(abs(a.e - w.e)), 7) AS vertical, round(max(abs(a.e - t.e)), 7) AS transpose FROM v a
JOIN v h ON h.vec_id = a.vec_id AND h.y = a.y AND h.x = 7 - a.x JOIN v w ON w.vec_id = a.vec_id AND w.x = a.x AND w.y = 7 - a.y JOIN v t ON t.vec_id = a.vec_id AND t.x = a.y AND t.y = a.x GROUP BY a.vec_id""",
    "area_resample": f"""WITH v AS ({_V}), t AS (SELECT range AS cell FROM range(24)),
o AS (SELECT vec_id, cell, e, least((i + 1) / 64::DOUBLE, (cell + 1) / 24::DOUBLE) - greatest(i / 64::DOUBLE, cell / 24::DOUBLE) AS w FROM v JOIN t ON i * 24 < (cell + 1) * 64 AND (i + 1) * 24 > cell * 64)
SELECT vec_id, cell, round(sum(e * w) * 24, 7) AS value FROM o GROUP BY ALL""",
    "area_resample_2d": f"""WITH {_P}, g AS (SELECT a.range AS cy, b.range AS cx FROM range(3) a, range(5) b),
o AS (SELECT vec_id, cy, cx, e * (least((y + 1) / 8::DOUBLE, (cy + 1) / 3::DOUBLE) - greatest(y / 8::DOUBLE, cy / 3::DOUBLE)) * 3 * (least((x + 1) / 8::DOUBLE, (cx + 1) / 5::DOUBLE) - greatest(x / 8::DOUBLE, cx / 5::DOUBLE)) * 5 AS w
  FROM v JOIN g ON y * 3 < (cy + 1) * 8 AND (y + 1) * 3 > cy * 8 AND x * 5 < (cx + 1) * 8 AND (x + 1) * 5 > cx * 8)
SELECT vec_id, cy AS y, cx AS x, round(sum(w), 7) AS value FROM o GROUP BY ALL""",
    "spatial_integral": f"WITH v AS ({_V}) SELECT vec_id, round(sum(e) * 4e-2::DOUBLE, 7) AS integral FROM v GROUP BY vec_id",
    "esf_bins": """WITH r AS (SELECT l_returnflag, pow(l_quantity, 3) AS q, l_extendedprice AS v FROM lineitem), w AS (SELECT l_returnflag, min(q) AS lo, max(q) AS hi FROM r GROUP BY ALL),
b AS (SELECT l_returnflag, greatest(least(floor((q - lo) / (hi - lo) * 37), 36), 0)::INTEGER AS bin, avg(v) AS mean FROM r JOIN w USING (l_returnflag) GROUP BY ALL),
e AS (SELECT w.l_returnflag, g.range::INTEGER AS bin, lo + (g.range + 0.5::DOUBLE) * (hi - lo) / 37 AS c, mean FROM w, range(37) g LEFT JOIN b ON b.l_returnflag = w.l_returnflag AND b.bin = g.range),
n AS (SELECT *, last_value(CASE WHEN mean IS NOT NULL THEN c END IGNORE NULLS) OVER p AS ax, last_value(mean IGNORE NULLS) OVER p AS ay, first_value(CASE WHEN mean IS NOT NULL THEN c END IGNORE NULLS) OVER f AS bx, first_value(mean IGNORE NULLS) OVER f AS vb
  FROM e WINDOW p AS (PARTITION BY l_returnflag ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY l_returnflag ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT l_returnflag, bin, round(c, 4) AS centre, round(CASE WHEN ax IS NULL THEN vb WHEN bx IS NULL OR ax = bx THEN ay ELSE ay + (vb - ay) / (bx - ax) * (c - ax) END, 4) AS value FROM n""",
    "edge_line": "SELECT l_returnflag, round(regr_slope(l_discount, l_quantity), 7) AS slope, round(regr_intercept(l_discount, l_quantity), 7) AS intercept, round(degrees(atan(abs(regr_slope(l_discount, l_quantity)))), 7) AS angle FROM lineitem GROUP BY ALL",
    "kernel_axis_mtf": f"""WITH {_P}, s AS (SELECT vec_id, x, sum(p) AS p FROM v GROUP BY ALL), w AS (SELECT *, unnest({_W}) AS frequency FROM s),
t AS (SELECT vec_id, frequency, sum(p * cos({-2 * math.pi!r}::DOUBLE * frequency * x)) AS re, sum(p * sin({-2 * math.pi!r}::DOUBLE * frequency * x)) AS im, sum(p) AS dc FROM w GROUP BY ALL)
SELECT vec_id, frequency, round(sqrt(re * re + im * im) / abs(dc), 7) AS magnitude FROM t""",
    "curve_gradient": f"""WITH v AS ({_V}), l AS (SELECT vec_id, i, e, lag(e) OVER w AS a, lead(e) OVER w AS b FROM v WINDOW w AS (PARTITION BY vec_id ORDER BY i))
SELECT vec_id, i::INTEGER AS i, round(CASE WHEN a IS NULL THEN b - e WHEN b IS NULL THEN e - a ELSE (b - a) / 2 END, 7) AS slope FROM l""",
    "interp_lookup": """WITH c AS (SELECT n_nationkey * 9.5::DOUBLE AS x, sqrt(n_nationkey) AS y, lead(n_nationkey) OVER (ORDER BY n_nationkey) * 9.5::DOUBLE AS x1, sqrt(lead(n_nationkey) OVER (ORDER BY n_nationkey)) AS y1 FROM nation)
SELECT event_id, value AS "at", round(CASE WHEN e.value < 0 THEN 0.0 WHEN c.x1 IS NULL THEN c.y ELSE c.y + (c.y1 - c.y) / (c.x1 - c.x) * (e.value - c.x) END, 7) AS value FROM events e ASOF LEFT JOIN c ON e.value >= c.x""",
    "interp_lookup_keyed": """WITH c AS (SELECT o_custkey AS k, dayofyear(o_orderdate) AS x, ln(max(o_totalprice)) AS y FROM orders GROUP BY ALL),
p AS (SELECT c_custkey AS k, c_nationkey * 14 AS x FROM customer), a AS (SELECT p.k, p.x, c.x AS ax, c.y AS ay FROM p ASOF LEFT JOIN c ON p.k = c.k AND p.x >= c.x), b AS (SELECT p.k, c.x AS bx, c.y AS vb FROM p ASOF LEFT JOIN c ON p.k = c.k AND p.x < c.x)
SELECT a.k AS c_custkey, round(CASE WHEN ax IS NULL THEN vb WHEN bx IS NULL OR ax = x THEN ay ELSE ay + (vb - ay) / (bx - ax) * (x - ax) END, 7) AS value FROM a JOIN b USING (k)""",
    "selection_offset_limit": "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 25 OFFSET 37",
    "topk_100_cap": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 5",
    "filter_before_limit": "SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "shard_partition": "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS ordinal, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 250)::BIGINT AS shard FROM orders",
    "iou_pairs": """WITH b AS (SELECT DISTINCT l_suppkey, l_orderkey * 10 + l_linenumber AS id, l_quantity AS x1, l_discount * 100 AS y1, l_quantity + 10 + l_linenumber AS x2, l_discount * 100 + l_tax * 100 + 1 AS y2 FROM lineitem),
p AS (SELECT a.l_suppkey, a.id, b.id AS other, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM b a JOIN b ON a.l_suppkey = b.l_suppkey AND a.id < b.id)
SELECT l_suppkey, id, other, round(i / (s - i), 7) AS iou FROM p WHERE i > 0""",
    "merge_coverage": """WITH p AS (SELECT CASE WHEN l_orderkey % 89 = 0 THEN -l_orderkey ELSE l_orderkey END AS id, l_orderkey % 7 AS piece, l_orderkey * 10 + l_linenumber AS n FROM lineitem WHERE l_linenumber = 1 OR l_orderkey % 97 = 0),
s AS (SELECT id, count(*) AS c FROM p GROUP BY id), f AS (SELECT CASE WHEN c IS NULL THEN 'missing' WHEN o_orderkey IS NULL THEN 'unexpected' WHEN c > 1 THEN 'overlap' END AS problem, coalesce(id, o_orderkey) AS id FROM orders FULL JOIN s ON id = o_orderkey),
u AS (SELECT 'order' AS problem, id, lag(id) OVER (PARTITION BY piece ORDER BY n) AS last FROM p)
SELECT problem, id, count(*)::BIGINT AS times FROM (SELECT problem, id FROM f WHERE problem IS NOT NULL UNION ALL SELECT problem, id FROM u WHERE id <= last) GROUP BY ALL""",
}

"""Row-by-row queries: colour, focus, sensor, noise and boxes over the driver tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.functions import color, geometry, noise, optics, sensor
from lumenspark.sources.tables import table

KEYS = ("l_orderkey", "l_linenumber")


def _r(column: Column, name: str, digits: int = 9) -> Column:
    """Rounded, so that engines agree to the last digit shown."""
    return F.round(column, digits).alias(name)


def _items(spark: SparkSession, folder: str) -> DataFrame:
    """Three channels in 0 to 1 for each line item."""
    return table(spark, folder, "lineitem").select(*KEYS, F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), (F.col("l_discount") * 10).alias("r"), (F.col("l_tax") * 12).alias("g"), (F.col("l_quantity") / 50).alias("b"))


_ITEMS = "SELECT l_orderkey, l_linenumber, l_partkey AS x, l_suppkey AS y, l_discount * 10 AS r, l_tax * 12 AS g, l_quantity / 50 AS b FROM lineitem"


def srgb_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    rows = _items(spark, folder)
    return rows.select(*KEYS, _r(color.srgb_decode(F.col("r")), "linear"), _r(color.srgb_encode(F.col("g")), "code"), _r(color.srgb_encode(color.srgb_decode(F.col("b"))), "back"))


def luminance_tone(spark: SparkSession, folder: str) -> DataFrame:
    rgb = tuple(F.col(c) for c in "rgb")
    toned = color.global_tone(*rgb, 0.8)
    return _items(spark, folder).select(*KEYS, _r(color.luminance(*rgb), "light"), _r(color.gray(*rgb), "gray"), _r(color.stop_ratio(F.col("b"), 0.8), "curve"), *[_r(color.clip_unit(c), f"tone_{n}") for c, n in zip(toned, "rgb", strict=True)], color.is_rgb(*rgb, 0.0, 1.0).alias("valid"))


BALANCE, MATRIX = (1.9, 1.0, 1.5), ((1.6, -0.4, -0.2), (-0.3, 1.5, -0.2), (0.0, -0.6, 1.6))


def color_transform(spark: SparkSession, folder: str) -> DataFrame:
    made = color.transformed(tuple(F.col(c) for c in "rgb"), BALANCE, MATRIX)
    return _items(spark, folder).select(*KEYS, *[_r(c, n) for c, n in zip(made, "rgb", strict=True)], *[_r(color.clip_negative(c), f"{n}_kept") for c, n in zip(made, "rgb", strict=True)])


def focus_conversion(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    focal, distance = F.lit(0.05), F.col("p_size") + F.lit(0.5)
    waves = F.col("p_retailprice") / 1000 - 1
    n, wl = F.lit(4.0), F.lit(550e-9)
    offset = optics.image_offset(waves, n, wl)
    image = optics.image_distance(focal, distance)
    return p.select(
        "p_partkey", _r(image, "image_distance", 12), _r(optics.edge_waves_from_conjugates(distance, F.lit(0.05), focal, F.lit(0.00625), wl), "conjugate_waves", 6),
        _r(optics.offset_from_focal_change(focal, F.lit(0.051), distance), "focal_offset", 12), _r(optics.offset_from_distance_change(focal, F.lit(2.0), distance), "distance_offset", 12),
        _r(offset, "image_offset", 12), _r(optics.edge_waves(offset, n, wl), "waves"), _r(optics.circle_of_confusion(offset, n), "confusion", 12), _r(optics.airy_radius(n, wl), "airy", 12),
        _r(optics.on_axis_ratio(waves), "on_axis"), _r(optics.scaled_defocus(waves, wl, F.lit(620e-9)), "scaled"), _r(optics.defocus_phase(F.col("p_size") / 50, waves), "phase"), optics.aperture(F.col("p_size") / 50, waves).alias("aperture"),
    )


def gaussian_forms(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    f = F.col("p_size") / 100
    sigma = optics.sigma_for_mtf50(f)
    return p.select("p_partkey", _r(sigma, "sigma"), _r(optics.sigma_for_energy(F.col("p_size") / F.lit(10.0), F.lit(0.8)), "sigma_ee80"), _r(optics.gaussian_mtf(sigma, f), "half"), _r(optics.gaussian_mtf(F.lit(0.9), f), "mtf"))


CONVERSION, ANALOG, BLACK, BITS, WELL, REFERENCE = 0.7, 1.5, 64, 10, 900.0, 800.0


def adc_quantize(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    stops = F.col("l_linenumber").cast("double") - 1
    electrons = sensor.photoelectrons(F.col("l_quantity") / 50, F.lit(REFERENCE), stops)
    dn = sensor.adc(electrons, F.lit(CONVERSION), F.lit(ANALOG), F.lit(float(BLACK)), F.lit(BITS))
    limit = sensor.adc_limit(F.lit(CONVERSION), F.lit(ANALOG), F.lit(float(BLACK)), F.lit(BITS))
    seconds = sensor.exposure_seconds(F.lit(0.01), stops, sensor.SHUTTER_TIME)
    gain = sensor.compensating_gain(sensor.budget(stops), F.lit(ANALOG))
    return rows.select(
        *KEYS, _r(electrons, "electrons"), dn.alias("dn"), _r(sensor.normalized(dn, F.lit(float(BLACK)), gain, F.lit(CONVERSION), F.lit(REFERENCE)), "signal"), _r(sensor.dark_electrons(F.lit(100.0), seconds), "dark"),
        sensor.limiting_stage(F.lit(WELL), limit).alias("limiting"), _r(sensor.headroom(F.lit(REFERENCE), F.lit(WELL), limit), "headroom"),
        sensor.adc(F.col("l_linenumber") + F.lit(0.5), F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(BITS)).alias("tie"),
    )


def bayer_mosaic(spark: SparkSession, folder: str) -> DataFrame:
    rgb = [F.col(c) for c in "rgb"]
    y, x = F.col("y"), F.col("x")
    return _items(spark, folder).select(*KEYS, *[sensor.cfa_channel(y, x, p).alias(p.lower()) for p in sensor.PATTERNS], _r(sensor.mosaic(*rgb, y, x, "RGGB"), "sample"), sensor.photosite_counter(y, x, sensor.cfa_channel(y, x, "RGGB"), F.lit(640)).alias("counter"))


def readout_rows(spark: SparkSession, folder: str) -> DataFrame:
    frames = table(spark, folder, "supplier").select("s_suppkey", (F.col("s_suppkey") / 30).alias("begin"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("row"))
    args = F.col("begin"), F.col("row"), F.lit(2e-5)
    return frames.select("s_suppkey", "row", _r(sensor.row_start(*args), "start"), _r(sensor.row_midpoint(*args, F.lit(0.004)), "middle"))


NOISE_SEED = 0x243F6A8885A308D3


def splitmix_uniform(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_orderkey")
    word = noise.splitmix64(F.col("o_orderkey"), NOISE_SEED)
    return rows.select("o_orderkey", word.alias("word"), noise.open_uniform(word).alias("u"))


def letterbox_fit(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").select("p_partkey", (F.col("p_size") * 13 + 7).alias("h"), (F.col("p_partkey") % 900 + 1).alias("w"))
    fit = geometry.letterbox(F.col("h"), F.col("w"), 640, 512)
    return rows.select("p_partkey", fit.resized_h.alias("resized_h"), fit.resized_w.alias("resized_w"), *[getattr(fit, n).cast("bigint").alias(n) for n in ("left", "top", "right", "bottom")], _r(fit.scale_x, "scale_x"), _r(fit.scale_y, "scale_y"))


def _boxes(spark: SparkSession, folder: str) -> DataFrame:
    left, top = F.col("l_quantity") * 10, F.col("l_extendedprice") % 700
    return table(spark, folder, "lineitem").select(
        *KEYS, (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("image_id"), F.lit(480).alias("height"), (F.col("l_suppkey") % 500 + 141).alias("width"), left.alias("x1"), top.alias("y1"),
        (left + F.col("l_discount") * 1000).alias("x2"), (top + F.col("l_tax") * 1000).alias("y2"), (F.col("l_partkey") % 85).alias("label"), F.col("l_discount").alias("score"),
    )


_BOXES = """SELECT l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber AS image_id, 480 AS height, l_suppkey % 500 + 141 AS width, l_quantity * 10 AS x1,
  l_extendedprice % 700 AS y1, l_quantity * 10 + l_discount * 1000 AS x2, l_extendedprice % 700 + l_tax * 1000 AS y2, l_partkey % 85 AS label, l_discount AS score FROM lineitem"""
_FIT = """g AS (SELECT *, least(640::DOUBLE / height, 640::DOUBLE / width) AS s FROM b),
h AS (SELECT *, least(640, greatest(1, floor(height * s + 0.5::DOUBLE)))::BIGINT AS rh, least(640, greatest(1, floor(width * s + 0.5::DOUBLE)))::BIGINT AS rw FROM g),
f AS (SELECT *, (640 - rw) // 2 AS pl, (640 - rh) // 2 AS pt, rw::DOUBLE / width AS sx, rh::DOUBLE / height AS sy FROM h)"""


def box_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    fit = geometry.letterbox(F.col("height"), F.col("width"), 640, 640)
    box = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
    there = geometry.forward_box(box, fit)
    return _boxes(spark, folder).select(*KEYS, *[_r(c, f"to_{n}", 6) for c, n in zip(there, ("x1", "y1", "x2", "y2"), strict=True)], *[_r(c, f"back_{n}", 6) for c, n in zip(geometry.inverse_box(there, fit), ("x1", "y1", "x2", "y2"), strict=True)])


def native_predictions(spark: SparkSession, folder: str) -> DataFrame:
    made = geometry.native_predictions(_boxes(spark, folder), 640, 640, dense_labels=True)
    return made.select("image_id", *[_r(F.col(c), c, 6) for c in ("x1", "y1", "x2", "y2")], "label", "score")


def label_map(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").select("p_partkey", (F.col("p_partkey") % 80).alias("dense"))
    return rows.select("p_partkey", "dense", geometry.sparse_label(F.col("dense")).cast("bigint").alias("sparse"))


QUERIES = {f.__name__: f for f in (srgb_roundtrip, luminance_tone, color_transform, focus_conversion, gaussian_forms, adc_quantize, bayer_mosaic, readout_rows, splitmix_uniform, letterbox_fit, box_roundtrip, native_predictions, label_map)}


def _d(x: float) -> str:
    return f"{x!r}::DOUBLE"


_DEC = "CASE WHEN {0} <= 0.04045::DOUBLE THEN {0} / 12.92::DOUBLE ELSE pow(({0} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"
_ENC = "CASE WHEN {0} <= 0.0031308::DOUBLE THEN {0} * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow({0}, 1 / 2.4::DOUBLE) - 0.055::DOUBLE END"
_SPARSE = "list_value(" + ",".join(map(str, geometry.SPARSE_LABELS)) + ")"
_LIGHT = "0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b"
_MUL = "((({0} & 4294967295::HUGEINT) * ({1} & 4294967295::HUGEINT) + (((({0} >> 32) * ({1} & 4294967295::HUGEINT) + ({0} & 4294967295::HUGEINT) * ({1} >> 32)) & 4294967295::HUGEINT) << 32)) & 18446744073709551615::HUGEINT)"


def _noise_sql() -> str:
    gamma, a, b = (f"{x}::HUGEINT" for x in ((noise.GAMMA + NOISE_SEED) % (1 << 64), noise.MIX_A, noise.MIX_B))
    return f"""
WITH s AS (SELECT o_orderkey, (o_orderkey::HUGEINT + {gamma}) & 18446744073709551615::HUGEINT AS x FROM orders),
a AS (SELECT o_orderkey, xor(x, x >> 30) AS x FROM s), b AS (SELECT o_orderkey, {_MUL.format("x", a)} AS x FROM a),
c AS (SELECT o_orderkey, xor(x, x >> 27) AS x FROM b), d AS (SELECT o_orderkey, {_MUL.format("x", b)} AS x FROM c),
e AS (SELECT o_orderkey, xor(x, x >> 31) AS x FROM d)
SELECT o_orderkey, (CASE WHEN x >= 9223372036854775808::HUGEINT THEN x - 18446744073709551616::HUGEINT ELSE x END)::BIGINT AS word,
  (x >> 12)::DOUBLE * pow(2::DOUBLE, -52) + pow(2::DOUBLE, -53) AS u FROM e"""


_M = [" + ".join(f"{_d(m)} * ({c} * {_d(w)})" for m, c, w in zip(row, "rgb", BALANCE, strict=True)) for row in MATRIX]
_ADC = "least(greatest(round_even({0}, 0), 0), 1023)::BIGINT"

ORACLE_SQL = {
    "srgb_roundtrip": f"WITH i AS ({_ITEMS}), d AS (SELECT *, {_DEC.format('b')} AS lb FROM i) SELECT l_orderkey, l_linenumber, round({_DEC.format('r')}, 9) AS linear, round({_ENC.format('g')}, 9) AS code, round({_ENC.format('lb')}, 9) AS back FROM d",
    "luminance_tone": f"""WITH i AS ({_ITEMS}), l AS (SELECT *, {_LIGHT} AS v FROM i), t AS (SELECT *, CASE WHEN v > 0 THEN 0.18::DOUBLE * pow(v / 0.18::DOUBLE, 0.8::DOUBLE) / v ELSE 0 END AS k FROM l)
SELECT l_orderkey, l_linenumber, round(v, 9) AS light, round(v, 9) AS gray, round(CASE WHEN b > 0 THEN 0.18::DOUBLE * pow(b / 0.18::DOUBLE, 0.8::DOUBLE) ELSE 0 END, 9) AS curve,
  {", ".join(f"round(least(greatest({c} * k, 0), 1), 9) AS tone_{c}" for c in "rgb")}, r BETWEEN 0 AND 1 AND g BETWEEN 0 AND 1 AND b BETWEEN 0 AND 1 AS valid FROM t""",
    "color_transform": f"WITH i AS ({_ITEMS}), t AS (SELECT l_orderkey, l_linenumber, {', '.join(f'{m} AS {c}' for m, c in zip(_M, 'rgb', strict=True))} FROM i) SELECT l_orderkey, l_linenumber, {', '.join(f'round({c}, 9) AS {c}, round(greatest({c}, 0), 9) AS {c}_kept' for c in 'rgb')} FROM t",
    "focus_conversion": f"""WITH p AS (SELECT p_partkey, p_size + 0.5::DOUBLE AS s, p_size / 50::DOUBLE AS q, p_retailprice / 1000 - 1 AS w, 0.05::DOUBLE AS f, 550e-9::DOUBLE AS wl, 4::DOUBLE AS n FROM part),
o AS (SELECT *, -8 * wl * n * n * w AS off, f * s / (s - f) AS im FROM p)
SELECT p_partkey, round(im, 12) AS image_distance, round(0.00625::DOUBLE * 0.00625::DOUBLE * (1 / s + 1 / 0.05::DOUBLE - 1 / f) / (2 * wl), 6) AS conjugate_waves,
  round(0.051::DOUBLE * s / (s - 0.051::DOUBLE) - im, 12) AS focal_offset, round(im - f * 2::DOUBLE / (2::DOUBLE - f), 12) AS distance_offset, round(off, 12) AS image_offset, round(-off / (8 * wl * n * n), 9) AS waves,
  round(abs(off) / n, 12) AS confusion, round({_d(optics.AIRY_ZERO)} * wl * n, 12) AS airy, round(CASE WHEN w = 0 THEN 1 ELSE pow(sin({_d(math.pi)} * w) / ({_d(math.pi)} * w), 2) END, 9) AS on_axis,
  round(w * wl / 620e-9::DOUBLE, 9) AS scaled, round(2 * {_d(math.pi)} * w * q, 9) AS phase, CASE WHEN q * q + w * w <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS aperture FROM o""",
    "gaussian_forms": f"""WITH p AS (SELECT p_partkey, p_size / 100::DOUBLE AS f, p_size / 10::DOUBLE AS r FROM part), s AS (SELECT *, {_d(math.sqrt(math.log(2)))} / ({_d(math.sqrt(2) * math.pi)} * f) AS sigma FROM p)
SELECT p_partkey, round(sigma, 9) AS sigma, round(r / sqrt(-2 * ln(1 - 0.8::DOUBLE)), 9) AS sigma_ee80, round(exp(-2 * {_d(math.pi**2)} * sigma * sigma * f * f), 9) AS half, round(exp(-2 * {_d(math.pi**2)} * 0.81::DOUBLE * f * f), 9) AS mtf FROM s""",
    "adc_quantize": f"""WITH e AS (SELECT l_orderkey, l_linenumber, pow(2::DOUBLE, -(l_linenumber - 1)) AS k, pow(2::DOUBLE, -(l_linenumber - 1)) * 800::DOUBLE * (l_quantity / 50) AS e FROM lineitem),
d AS (SELECT *, {_ADC.format("64::DOUBLE + 0.7::DOUBLE * 1.5::DOUBLE * e")} AS dn FROM e)
SELECT l_orderkey, l_linenumber, round(e, 9) AS electrons, dn, round(1 / (k * 1.5::DOUBLE) * (dn - 64::DOUBLE) / (0.7::DOUBLE * 800::DOUBLE), 9) AS signal, round(100::DOUBLE * (0.01::DOUBLE * k), 9) AS dark,
  CASE WHEN (1023 - 64) / (0.7::DOUBLE * 1.5::DOUBLE) < 900 THEN 'adc' ELSE 'full_well' END AS limiting, round(least(900::DOUBLE, (1023 - 64) / (0.7::DOUBLE * 1.5::DOUBLE)) - 800::DOUBLE, 9) AS headroom, {_ADC.format("l_linenumber + 0.5::DOUBLE")} AS tie FROM d""",
    "bayer_mosaic": f"""WITH i AS ({_ITEMS}), t AS (SELECT *, (y % 2) * 2 + x % 2 + 1 AS k FROM i)
SELECT l_orderkey, l_linenumber, {", ".join(f"(list_value({', '.join(map(str, tile))}))[k]::INTEGER AS {name.lower()}" for name, tile in sensor.PATTERNS.items())},
  round((list_value(r, g, b))[(list_value(0, 1, 1, 2))[k] + 1], 9) AS sample, ((y * 640 + x) * 3 + (list_value(0, 1, 1, 2))[k])::BIGINT AS counter FROM t""",
    "readout_rows": "SELECT s_suppkey, r.range::INTEGER AS row, round(s_suppkey / 30 + r.range * 2e-5::DOUBLE, 9) AS start, round(s_suppkey / 30 + r.range * 2e-5::DOUBLE + 0.004::DOUBLE / 2, 9) AS middle FROM supplier, range(8) r",
    "splitmix_uniform": _noise_sql(),
    "letterbox_fit": """WITH b AS (SELECT p_partkey, p_size * 13 + 7 AS h, p_partkey % 900 + 1 AS w FROM part), s AS (SELECT *, least(640::DOUBLE / h, 512::DOUBLE / w) AS s FROM b),
f AS (SELECT *, least(640, greatest(1, floor(h * s + 0.5::DOUBLE)))::BIGINT AS rh, least(512, greatest(1, floor(w * s + 0.5::DOUBLE)))::BIGINT AS rw FROM s)
SELECT p_partkey, rh AS resized_h, rw AS resized_w, ((512 - rw) // 2)::BIGINT AS "left", ((640 - rh) // 2)::BIGINT AS top, (512 - rw - (512 - rw) // 2)::BIGINT AS "right", (640 - rh - (640 - rh) // 2)::BIGINT AS bottom,
  round(rw::DOUBLE / w, 9) AS scale_x, round(rh::DOUBLE / h, 9) AS scale_y FROM f""",
    "box_roundtrip": f"""WITH b AS ({_BOXES}), {_FIT}
SELECT l_orderkey, l_linenumber, round(x1 * sx + pl, 6) AS to_x1, round(y1 * sy + pt, 6) AS to_y1, round(x2 * sx + pl, 6) AS to_x2, round(y2 * sy + pt, 6) AS to_y2,
  round((x1 * sx + pl - pl) / sx, 6) AS back_x1, round((y1 * sy + pt - pt) / sy, 6) AS back_y1, round((x2 * sx + pl - pl) / sx, 6) AS back_x2, round((y2 * sy + pt - pt) / sy, 6) AS back_y2 FROM f""",
    "native_predictions": f"""WITH b AS ({_BOXES}), {_FIT},
n AS (SELECT image_id, least(greatest((x1 - pl) / sx, 0), width) AS x1, least(greatest((y1 - pt) / sy, 0), height) AS y1, least(greatest((x2 - pl) / sx, 0), width) AS x2, least(greatest((y2 - pt) / sy, 0), height) AS y2, label, score FROM f)
SELECT image_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, CASE WHEN label < 80 THEN ({_SPARSE})[label + 1] END::BIGINT AS label, score FROM n WHERE x2 > x1 AND y2 > y1""",
    "label_map": f"SELECT p_partkey, p_partkey % 80 AS dense, (({_SPARSE})[p_partkey % 80 + 1])::BIGINT AS sparse FROM part",
}

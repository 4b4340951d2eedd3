"""Queries on plans, identities and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.functions.identity import canonical_long, canonical_map, canonical_text, digest
from lumenspark.operators import study
from lumenspark.sources.tables import table


def cell_plan(spark: SparkSession, folder: str) -> DataFrame:
    return study.publication_cells(spark)


def cell_counts(spark: SparkSession, folder: str) -> DataFrame:
    return study.publication_cells(spark).groupBy("detector_id", "family").agg(F.count(F.lit(1)).alias("cells"))


def curve_cell_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return study.curve_cells(study.publication_cells(spark), "first", "primary").select("waves", (F.col("physical") != F.col("comparator")).alias("differ"))


def legal_transitions(spark: SparkSession, folder: str) -> DataFrame:
    return study.transitions(spark)


def stage_graph(spark: SparkSession, folder: str) -> DataFrame:
    line = F.array(*map(F.lit, study.LDR))
    n = len(study.LDR) - 1
    stages = table(spark, folder, "orders").select(F.col("o_orderkey").alias("pipeline"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("idx"))
    skip = (F.col("pipeline") % 70 == 0) & (F.col("idx") == 5)
    stages = stages.select("pipeline", F.lit("ldr").alias("mode"), "idx", F.element_at(line, F.col("idx") + 1).alias("input_domain"), F.element_at(line, F.least(F.col("idx") + 2 + skip.cast("int"), F.lit(n + 1))).alias("output_domain"), F.lit("1").alias("input_units"), F.when((F.col("pipeline") % 110 == 0) & (F.col("idx") == 2), "e").otherwise("1").alias("output_units"))
    return study.illegal_stages(stages, study.transitions(spark)).select("pipeline", "idx", "problem")


def selection_identity(spark: SparkSession, folder: str) -> DataFrame:
    return study.axis_identity(table(spark, folder, "orders"), ["o_orderpriority"], "o_orderkey")


def row_identity(spark: SparkSession, folder: str) -> DataFrame:
    record = canonical_map({"id": canonical_long(F.col("p_partkey")), "name": canonical_text(F.col("p_name")), "size": canonical_long(F.col("p_size").cast("bigint"))})
    return table(spark, folder, "part").select("p_partkey", digest(record).alias("sha256"))


def study_completion(spark: SparkSession, folder: str) -> DataFrame:
    cells = table(spark, folder, "supplier").select(F.col("s_suppkey").cast("string").alias("cell_sha256"))
    rows = table(spark, folder, "lineitem").where("l_suppkey % 9 <> 0").select((F.col("l_suppkey") + F.when(F.col("l_orderkey") % 1000 == 0, 50).otherwise(0)).cast("string").alias("cell_sha256"), F.col("l_linenumber").alias("image_id")).distinct()
    return study.completion(cells, rows, 7)


def evidence_tier(spark: SparkSession, folder: str) -> DataFrame:
    checks = {"large": F.col("p_size") > 10, "named": F.col("p_name").isNotNull(), "cheap": F.col("p_retailprice") < 1500}
    record, tier = study.tier(checks)
    return table(spark, folder, "part").select("p_partkey", *[record[n].alias(n) for n in checks], tier.alias("tier"))


QUERIES = {f.__name__: f for f in (cell_plan, cell_counts, curve_cell_pairs, legal_transitions, stage_graph, selection_identity, row_identity, study_completion, evidence_tier)}

_CELLS = """d AS (SELECT * FROM (VALUES ('first', 'primary', true), ('first', 'replication', true), ('second', 'primary', false), ('third', 'primary', false), ('fourth', 'primary', false)) t(detector_id, profile_id, everything)),
w AS (SELECT unnest([0.5::DOUBLE, 0.75::DOUBLE, 1::DOUBLE, 1.5::DOUBLE, 2::DOUBLE, 3::DOUBLE]) AS waves),
a AS (SELECT unnest(['untouched_input', 'modeled_neutral']) AS kind, NULL::DOUBLE AS waves UNION ALL SELECT k.kind, waves FROM w, (SELECT unnest(['physical', 'gaussian', 'quadratic_cosine', 'sampled_incoherent']) AS kind) k),
c AS (SELECT detector_id, CASE WHEN waves IS NULL THEN 'baseline' WHEN kind = 'physical' THEN 'physical_defocus' ELSE 'mechanism_comparator' END AS family, waves, kind FROM d, a WHERE everything OR waves IS NULL OR (kind = 'physical' AND waves IN (0.5, 1.5, 3)))"""

ORACLE_SQL = {
    "cell_counts": f"WITH {_CELLS} SELECT detector_id, family, count(*)::BIGINT AS cells FROM c GROUP BY ALL",
    "curve_cell_pairs": "SELECT unnest([0.5::DOUBLE, 0.75::DOUBLE, 1::DOUBLE, 1.5::DOUBLE, 2::DOUBLE, 3::DOUBLE]) AS waves, true AS differ",
    "selection_identity": """WITH k AS (SELECT o_orderpriority, count(*)::BIGINT AS count, min(o_orderkey) AS first, max(o_orderkey) AS last, string_agg('i' || o_orderkey || ';', '' ORDER BY o_orderkey) AS items FROM orders GROUP BY ALL)
SELECT o_orderpriority, count, first, last, sha256('a' || count || '[' || items || ']') AS selection_sha256 FROM k""",
    "row_identity": "SELECT p_partkey, sha256('m3{s2:idi' || p_partkey || ';s4:names' || strlen(p_name) || ':' || p_name || 's4:sizei' || p_size || ';}') AS sha256 FROM part",
    "study_completion": """WITH c AS (SELECT s_suppkey::VARCHAR AS cell FROM supplier), r AS (SELECT DISTINCT (l_suppkey + CASE WHEN l_orderkey % 1000 = 0 THEN 50 ELSE 0 END)::VARCHAR AS cell, l_linenumber AS image FROM lineitem WHERE l_suppkey % 9 <> 0),
n AS (SELECT cell, count(*)::BIGINT AS rows, count(DISTINCT image)::BIGINT AS images FROM r GROUP BY cell),
f AS (SELECT coalesce(c.cell, n.cell) AS cell_sha256, rows, images, CASE WHEN c.cell IS NULL THEN 'not planned' WHEN rows IS NULL THEN 'missing' WHEN images <> 7 THEN 'incomplete' END AS problem FROM c FULL JOIN n ON c.cell = n.cell)
SELECT * FROM f WHERE problem IS NOT NULL""",
    "evidence_tier": """SELECT p_partkey, p_size > 10 AS "large", p_name IS NOT NULL AS named, p_retailprice < 1500 AS cheap,
  CASE WHEN p_size > 10 AND p_name IS NOT NULL AND p_retailprice < 1500 THEN 'publication_protocol_reproduction' ELSE 'exploratory_protocol_variant' END AS tier FROM part""",
    "stage_graph": """WITH o AS (SELECT o_orderkey AS p FROM orders)
SELECT p AS pipeline, 5 AS idx, 'illegal edge' AS problem FROM o WHERE p % 70 = 0 UNION ALL SELECT p, 6, 'domain breaks' FROM o WHERE p % 70 = 0 UNION ALL SELECT p, 3, 'units break' FROM o WHERE p % 110 = 0""",
}

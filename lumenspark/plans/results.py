"""Queries of run manifests, result tables and built-in cameras."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.operators import provenance, results, study
from lumenspark.operators.provenance import key_text
from lumenspark.sources.tables import table

_ABOUT = {"study_plan_sha256": "plan", "detector_id": "first", "profile_id": "primary"}


def run_manifest(spark: SparkSession, folder: str) -> DataFrame:
    images = table(spark, folder, "customer").select(F.col("c_custkey").alias("image_id"))
    cells = study.publication_cells(spark).select("cell_ordinal", "detector_id", "profile_id", "arm_id")
    return results.run_manifest(cells, images)


def secondary_results(spark: SparkSession, folder: str) -> DataFrame:
    """Event types as arms, users as replicates."""
    events = table(spark, folder, "events").select(F.col("event_type").alias("arm"), (F.col("user_id") % 50).alias("replicate"), F.lit("value").alias("metric"), F.col("value").cast("decimal(20,6)").alias("value"))
    mean = (F.sum("value").cast("double") / F.count("value")).alias("value")
    made = results.secondary_table(events.groupBy("arm", "replicate", "metric").agg(mean), events.groupBy("arm", "metric").agg(mean), "click", _ABOUT)
    return made.select(*[F.round(c, 9).alias(c) if c in ("estimate", "lower_95", "upper_95") else F.col(c) for c in made.columns])


def primary_results(spark: SparkSession, folder: str) -> DataFrame:
    """Line numbers as coordinates, suppliers as replicates: quantities against discounts."""
    rows = table(spark, folder, "lineitem").select((F.col("l_suppkey") % 40).alias("replicate"), F.lit("map50_95").alias("metric"), F.col("l_linenumber").cast("double").alias("waves"), F.col("l_quantity").cast("decimal(20,6)").alias("q"), F.col("l_discount").cast("decimal(20,6)").alias("d"))
    both = [(F.sum(c).cast("double") / F.count(c)).alias(n) for c, n in (("q", "physical"), ("d", "comparator"))]
    made = results.primary_table(rows.groupBy("metric", "waves").agg(*both), rows.groupBy("replicate", "metric", "waves").agg(*both), _ABOUT)
    return made.select(*[F.round(c, 9).alias(c) if c in ("estimate", "lower_95", "upper_95") else F.col(c) for c in made.columns])


def builtin_profiles(spark: SparkSession, folder: str) -> DataFrame:
    made = results.profile_rows(spark)
    return made.select("profile_id", "height", "width", *[F.round(c, 6).alias(c) for c in ("pitch_um", "f_number", "sampling", "first_zero_px")])


def artifact_identities(spark: SparkSession, folder: str) -> DataFrame:
    """Every text as an artifact."""
    rows = provenance.artifacts(table(spark, folder, "documents"), "doc_id", "text")
    return rows.withColumn("identity", F.sha2(provenance.artifact_canonical(F.col("name"), F.col("bytes"), F.col("sha256")), 256))


def model_identities(spark: SparkSession, folder: str) -> DataFrame:
    """Regions as models, their nations as artifacts."""
    nations = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = nations.select("r_name", F.col("n_name").alias("name"), F.octet_length("n_name").cast("bigint").alias("bytes"), F.sha2("n_name", 256).alias("sha256"))
    return provenance.models(rows, "r_name", "table")


QUERIES = {f.__name__: f for f in (artifact_identities, model_identities, run_manifest, secondary_results, primary_results, builtin_profiles)}

#: The plan's cells from the rule: arms in order for each detector and profile.
CELLS = """d AS (SELECT * FROM (VALUES ('first', 'primary', true, 0), ('first', 'replication', true, 1), ('second', 'primary', false, 2), ('third', 'primary', false, 3), ('fourth', 'primary', false, 4)) t(detector_id, profile_id, everything, turn)),
w AS (SELECT * FROM (VALUES (0.5::DOUBLE, '0p5'), (0.75::DOUBLE, '0p75'), (1::DOUBLE, '1'), (1.5::DOUBLE, '1p5'), (2::DOUBLE, '2'), (3::DOUBLE, '3')) t(waves, token)),
k AS (SELECT * FROM (VALUES ('physical', 0), ('gaussian', 1), ('quadratic_cosine', 2), ('sampled_incoherent', 3)) t(kind, place)),
a AS (SELECT * FROM (VALUES ('untouched_input', 'baseline', 'untouched_input', NULL::DOUBLE, 0, 0), ('modeled_neutral', 'baseline', 'modeled_neutral', NULL::DOUBLE, 0, 1)) t(arm_id, family, kind, waves, big, small)
  UNION ALL SELECT CASE WHEN kind = 'physical' THEN 'physical_w_' ELSE 'comparator_' || kind || '_w_' END || token, CASE WHEN kind = 'physical' THEN 'physical_defocus' ELSE 'mechanism_comparator' END, kind, waves, 1 + row_number() OVER (PARTITION BY kind ORDER BY waves), place FROM w, k),
c AS (SELECT *, (row_number() OVER (ORDER BY turn, big, small) - 1)::INTEGER AS cell_ordinal FROM d, a WHERE everything OR waves IS NULL OR (kind = 'physical' AND waves IN (0.5, 1.5, 3)))"""



def _map(**pairs: str) -> str:
    """SQL of the canonical map of text values, keys in order."""
    body = " || ".join(f"'s{len(k)}:{k}s' || length({v}) || ':' || {v}" for k, v in sorted(pairs.items()))
    return f"'m{len(pairs)}{{' || {body} || '}}'"


_ARTIFACT = f"'m3{{{key_text('bytes')}i' || bytes || ';{key_text('name')}s' || strlen(name) || ':' || name || '{key_text('sha256')}s64:' || sha256 || '}}'"

ORACLE_SQL = {
    "artifact_identities": f"""WITH a AS (SELECT doc_id::VARCHAR AS name, strlen(coalesce(text, ''))::BIGINT AS bytes, sha256(coalesce(text, '')) AS sha256 FROM documents)
SELECT *, sha256({_ARTIFACT}) AS identity FROM a""",
    "model_identities": f"""WITH a AS (SELECT r_name, n_name AS name, strlen(n_name) AS bytes, sha256(n_name) AS sha256 FROM nation JOIN region ON n_regionkey = r_regionkey),
m AS (SELECT r_name AS model_id, count(*)::INTEGER AS artifacts, string_agg({_ARTIFACT}, '' ORDER BY name) AS body FROM a GROUP BY 1)
SELECT model_id, artifacts, sha256('m6{{{key_text('artifacts')}a' || artifacts || '[' || body || ']{key_text('backend')}s5:table{key_text('identity_verified')}b1;{key_text('implementation')}n;{key_text('model_id')}s' || strlen(model_id) || ':' || model_id || '{key_text('revision')}n;}}') AS model_sha256 FROM m""",
    "cell_plan": f"""WITH {CELLS},
h AS (SELECT *, sha256({_map(arm="arm_id", family="family", profile="profile_id")}) AS condition_sha256 FROM c)
SELECT detector_id, profile_id, arm_id, family, kind, waves, condition_sha256, cell_ordinal, sha256({_map(arm_id="arm_id", condition_sha256="condition_sha256", detector_id="detector_id", profile_id="profile_id")}) AS cell_sha256 FROM h""",
    "legal_transitions": f"""WITH l AS (SELECT 'ldr' AS mode, string_split('{" ".join(study.LDR)}', ' ') AS d UNION ALL SELECT 'forward', string_split('{" ".join(study.FORWARD)}', ' ')),
e AS (SELECT mode, unnest(d[:len(d) - 1]) AS source, unnest(d[2:]) AS target FROM l UNION SELECT mode, unnest(d), unnest(d) FROM l
  UNION SELECT 'ldr', 'linear_rgb_optical', 'output_linear_rgb_signed' UNION SELECT 'forward', 'scene_spectral', 'photosite_expectation')
SELECT mode, source, target FROM e""",
    "run_manifest": f"""WITH {CELLS},
i AS (SELECT c_custkey AS image_id, row_number() OVER (ORDER BY c_custkey) - 1 AS ordinal FROM (SELECT DISTINCT c_custkey FROM customer)),
s AS (SELECT (ordinal // 250)::BIGINT AS shard, min(ordinal)::BIGINT AS first_ordinal, count(*)::BIGINT AS image_count, min(image_id) AS first_image_id, max(image_id) AS last_image_id FROM i GROUP BY 1)
SELECT s.*, cell_ordinal, detector_id, profile_id, arm_id FROM s, c""",
    "secondary_results": """WITH e AS (SELECT event_type AS arm, user_id % 50 AS replicate, value::DECIMAL(20,6) AS value FROM events),
r AS (SELECT arm, replicate, sum(value)::DOUBLE / count(value) AS v FROM e GROUP BY ALL), p AS (SELECT arm, sum(value)::DOUBLE / count(value) AS v FROM e GROUP BY ALL),
b AS (SELECT x.arm, x.v, y.v AS base FROM r x LEFT JOIN r y ON y.arm = 'click' AND x.replicate = y.replicate),
l AS (SELECT arm, 'marginal' AS estimand, v FROM b UNION ALL SELECT arm, 'difference', v - base FROM b UNION ALL SELECT arm, 'ratio', CASE WHEN base > 0 THEN v / base END FROM b),
q AS (SELECT arm, estimand, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi, count(v) = count(*) AND count(v) > 1 AS defined FROM l GROUP BY ALL),
m AS (SELECT x.arm, x.v, y.v AS base FROM p x, p y WHERE y.arm = 'click'),
f AS (SELECT arm, 'marginal' AS estimand, v FROM m UNION ALL SELECT arm, 'difference', v - base FROM m UNION ALL SELECT arm, 'ratio', CASE WHEN base > 0 THEN v / base END FROM m)
SELECT 'plan' AS study_plan_sha256, 'first' AS detector_id, 'primary' AS profile_id, f.arm AS arm_id, 'click' AS baseline_arm_id, 'value' AS metric, f.estimand, round(f.v, 9) AS estimate,
  CASE WHEN defined THEN round(lo, 9) END AS lower_95, CASE WHEN defined THEN round(hi, 9) END AS upper_95, false AS confirmatory FROM f JOIN q USING (arm, estimand)""",
    "primary_results": """WITH x AS (SELECT l_suppkey % 40 AS replicate, l_linenumber::DOUBLE AS waves, l_quantity::DECIMAL(20,6) AS q, l_discount::DECIMAL(20,6) AS d FROM lineitem),
r AS (SELECT replicate, waves, sum(q)::DOUBLE / count(q) - sum(d)::DOUBLE / count(d) AS gap FROM x GROUP BY ALL), p AS (SELECT waves, sum(q)::DOUBLE / count(q) - sum(d)::DOUBLE / count(d) AS gap FROM x GROUP BY ALL),
rp AS (SELECT *, (gap + lag(gap) OVER l) / 2 * (waves - lag(waves) OVER l) AS piece FROM r WINDOW l AS (PARTITION BY replicate ORDER BY waves)),
pp AS (SELECT *, (gap + lag(gap) OVER l) / 2 * (waves - lag(waves) OVER l) AS piece FROM p WINDOW l AS (ORDER BY waves)),
re AS (SELECT 'point_difference' AS estimand, waves, gap AS v FROM r UNION ALL SELECT 'curve_auc', NULL, coalesce(sum(piece), 0) FROM rp GROUP BY replicate),
pe AS (SELECT 'point_difference' AS estimand, waves, gap AS v FROM p UNION ALL SELECT 'curve_auc', NULL, coalesce(sum(piece), 0) FROM pp),
q AS (SELECT estimand, waves, CASE WHEN count(*) > 1 THEN quantile_cont(v, 0.025) END AS lo, CASE WHEN count(*) > 1 THEN quantile_cont(v, 0.975) END AS hi FROM re GROUP BY ALL)
SELECT 'plan' AS study_plan_sha256, 'first' AS detector_id, 'primary' AS profile_id, 'map50_95' AS metric, pe.estimand, pe.waves AS edge_waves_ref, round(pe.v, 9) AS estimate, round(lo, 9) AS lower_95, round(hi, 9) AS upper_95,
  CASE WHEN pe.estimand = 'curve_auc' THEN 'metric_waves' ELSE 'metric' END AS unit, pe.estimand = 'curve_auc' AS confirmatory FROM pe LEFT JOIN q ON q.estimand = pe.estimand AND q.waves IS NOT DISTINCT FROM pe.waves""",
    "builtin_profiles": """SELECT profile_id, height, width, pitch_um, f_number, round(f_number * 0.55 / pitch_um, 6) AS sampling, round(2 * 1.2196698912665045 * f_number * 0.55 / pitch_um, 6) AS first_zero_px
FROM (VALUES ('ldr', 8, 10, 4::DOUBLE, 4::DOUBLE), ('ldr_pilot', 120, 160, 4::DOUBLE, 4::DOUBLE), ('ldr_native', 640, 640, 4::DOUBLE, 4::DOUBLE), ('ldr_native_replication', 640, 640, 2.8::DOUBLE, 5.6::DOUBLE)) t(profile_id, height, width, pitch_um, f_number)""",
}

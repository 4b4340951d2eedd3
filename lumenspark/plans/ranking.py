"""Ranked-list queries: average precision of document length as a scorer of quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.operators.ranking import average_precision, precision_recall
from lumenspark.sources.tables import table


def ap_101_by_source(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    ranked = docs.join(labels, "doc_id")
    curve = precision_recall(ranked, ["source"], [F.desc("n_chars"), F.asc("doc_id")], "quality")
    return average_precision(curve, ["source"]).withColumn("ap", F.round("ap", 9))


QUERIES = {"ap_101_by_source": ap_101_by_source}

ORACLE_SQL = {
    "ap_101_by_source": """
WITH r AS (
  SELECT source, quality, row_number() OVER w AS n, sum(quality) OVER w AS tp, sum(quality) OVER (PARTITION BY source) AS pos
  FROM documents JOIN labels USING (doc_id)
  WINDOW w AS (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (SELECT source, n, pos, CASE WHEN pos > 0 THEN tp::DOUBLE / pos END AS recall, tp::DOUBLE / (n + 2.220446049250313e-16::DOUBLE) AS prec FROM r),
e AS (SELECT *, max(prec) OVER (PARTITION BY source ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM p),
t AS (SELECT range * 0.01::DOUBLE AS level FROM range(101)),
f AS (SELECT source, level, arg_min(env, n) AS env FROM e, t WHERE recall >= level GROUP BY ALL),
s AS (SELECT source, max(pos) AS pos, count(*) AS ranked FROM e GROUP BY source)
SELECT s.source, round(CASE WHEN pos > 0 THEN coalesce(sum(f.env), 0) / 101 ELSE -1.0::DOUBLE END, 9) AS ap, pos::BIGINT AS positives, ranked::BIGINT AS ranked
FROM s LEFT JOIN f ON f.source IS NOT DISTINCT FROM s.source GROUP BY s.source, pos, ranked
""",
}

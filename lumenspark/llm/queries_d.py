"""Queries on web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenspark.llm import warc
from lumenspark.llm.common import fresh_path


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    path = fresh_path(spark, "warc")
    index = warc.archive(pages, path)
    kind = pages.schema["page_id"].dataType
    found = warc.read(spark, f"{path}/archives", index, payloads=False)
    return found.select(found.page_id.cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", found.refers_to.cast(kind).alias("refers_to"))


QUERIES = {"op5_warc": op5_warc}

ORACLE_SQL = {
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS n, sha256(h) AS digest FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to
FROM f
""",
}

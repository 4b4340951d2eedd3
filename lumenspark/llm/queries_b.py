"""Queries of the line and token operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.llm import bpe
from lumenspark.llm.lines import LineIndex


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    index = LineIndex.empty(spark, min_docs=10, min_chars=1).insert(docs)
    found = index.rewrite(docs, keep=["doc_id"])
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def tokenizer_path() -> str:
    """The public vocabulary's file; its folder is installed, not part of the repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    made = bpe.encode(docs, tokenizer_path(), keep=["doc_id"], starts=False, decoded=True)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return made.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op4_line_dedup": op4_line_dedup, "op10_bpe": op10_bpe}

ORACLE_SQL = {
    "op4_line_dedup": """
WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM a),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(h.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE h.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN h ON k.key = h.key GROUP BY doc_id
""",
}

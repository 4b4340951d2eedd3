"""Queries of the learned operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.llm import pii, toxicity


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    found = toxicity.score(docs, model, ["doc_id"], evidence=0)
    return found.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = pii.find(docs, ["doc_id"])
    counts = [F.size(F.filter("base", _is(kind))).cast("bigint").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.as_text("base"), 256).alias("base_sha256"), pii.as_text("spans").alias("spans"))


def _is(kind: str):
    return lambda x: x["kind"] == kind


QUERIES = {"op2_pii": op2_pii, "op7_toxicity": op7_toxicity}
ORACLE_SQL: dict[str, str] = {}

"""Queries of the native operators: mixing, secrets and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.llm import mixing, multiset, secrets


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return mixing.Mix.of(docs.select("doc_id", "source", "text"), keep=["doc_id"]).taken().select("doc_id", "size", "source_size", "target", "taken")


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ledger = secrets.Ledger.empty(spark)
    paths = ledger.scan(docs, path="doc_id")
    found = ledger.report(paths)

    def of(kinds: list[str]) -> Column:
        return F.filter("spans", lambda x: x.kind.isin(kinds))

    base = of([r.kind for r in secrets.BASE])
    counts = [F.size(of([r.kind])).cast("bigint").alias(f"n_{r.kind}") for r in secrets.BASE]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = multiset.edited_fingerprints(docs)
    own, edited, after = (("lanes", "n"), ("edited_lanes", "edited_n"), ("next_lanes", "next_n"))
    pick = lambda pair: (F.col(pair[0]), F.col(pair[1]))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", multiset.written(*pick(own)).alias("fingerprint"), multiset.written(*pick(edited)).alias("edited_fingerprint"),
        multiset.likeness(*pick(own), *pick(edited)).alias("near_edited"), multiset.likeness(*pick(own), *pick(after)).alias("near_next"),
    )


QUERIES = {"op1_mixing": op1_mixing, "op6_secrets": op6_secrets, "op9_fingerprints": op9_fingerprints}

#: Fixed value of op6: the SQL of the rules beyond the base is the same pattern under RE2.
_RULES = {
    "assign": (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
}
for _rule in secrets.RULES[1:]:
    _RULES[_rule.kind] = (_rule.pattern, 0, _rule.least)


def _op6_sql() -> str:
    scans = "\nUNION ALL\n".join(
        f"SELECT doc_id, {i} AS rank, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS found, regexp_extract_all(t, '{p}', {g}) AS held, string_split_regex(t, '{p}') AS gaps, {least} AS least FROM d WHERE regexp_matches(t, '{p}')"
        for i, (kind, (p, g, least)) in enumerate(_RULES.items())
    )
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}')::BIGINT AS n_{r.kind}" for r in secrets.BASE)
    text = "kind || ':' || start || ':' || stop"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({scans}),
u AS (SELECT doc_id, rank, kind, least, generate_subscripts(found, 1) AS i, unnest(found) AS f, unnest(held) AS h, unnest(gaps[1:len(found)]) AS g FROM m),
s AS (SELECT *, sum(length(g) + length(f)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS stop FROM u),
k AS (SELECT doc_id, rank, kind, (stop - length(f))::BIGINT AS start, stop::BIGINT AS stop FROM s WHERE length(h) >= least),
b AS (SELECT doc_id, {counts}, string_agg({text}, ',' ORDER BY start, rank) FILTER (WHERE rank < {len(secrets.BASE)}) AS base, string_agg({text}, ',' ORDER BY start, rank) AS spans FROM k GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN b USING (doc_id)
"""


ORACLE_SQL: dict[str, str] = {"op6_secrets": _op6_sql()}

"""The corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents,
but for the last, which returns token ids. ``run`` writes each stage's rows as Parquet in the shared folder and reads
them again, so that a lost executor costs a part of one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.llm import bpe, simhash, toxicity
from lumenspark.llm.common import ROW, identified, stored, unused
from lumenspark.llm.lines import LineIndex, without_copies
from lumenspark.llm.mixing import Mix
from lumenspark.llm.queries_b import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 stay, null and empty texts among them. Learns from the labels not held out."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused(docs, "score")
    return toxicity.score(docs, model, docs.columns, evidence=0, names=(score, "")).where(F.col(score) < 0.5).select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more different texts go. Copies of a text count once: they are the next stage's work, and
    would otherwise lose every line. All documents stay; a null text becomes an empty one."""
    index = LineIndex.empty(spark, min_docs=10, min_chars=1).insert(without_copies(docs, "text", "doc_id"))
    names = tuple(unused(docs, x) for x in ("kept", "lines", "dropped"))
    kept = index.rewrite(docs, keep=[c for c in docs.columns if c not in ("text", "n_chars")], names=names)
    return kept.select(*[{"text": F.col(names[0]).alias("text"), "n_chars": _length(names[0], docs)}.get(c, F.col(f"`{c}`")) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or near-equal texts stays, that of the least id."""
    return simhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is taken up to its target: a row for each document and epoch, with the words that the mix takes."""
    made = Mix.of(identified(docs), keep=ROW).texts(docs, "text")
    return made.select(*[_length("text", docs) if c == "n_chars" else F.col(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, ids, n_tokens, and the digests of the ids and of the text that they decode to."""
    made = bpe.encode(docs, tokenizer_path(), keep=["doc_id", "source", "lang"], starts=False, decoded=True)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return made.select("doc_id", "source", "lang", "ids", F.size("ids").cast("bigint").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _length(column: str, docs: DataFrame):
    return F.length(column).cast(docs.schema["n_chars"].dataType).alias("n_chars")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("simhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: No stage but line dedup can be expressed in SQL: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

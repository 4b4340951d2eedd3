"""Queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from lumenspark.llm import catalogue

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_oracle(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        duck.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    frame = catalogue.QUERIES[name](spark, FOLDER)
    result = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    want = sorted((tuple(r[names.index(c)] for c in frame.columns) for r in result.fetchall()), key=repr)
    assert sorted((tuple(r) for r in frame.collect()), key=repr) == want


def test_names_and_guard():
    import __spark_entry__ as entry

    found = entry.queries()
    assert {f"op{i}" for i in range(1, 11)} == {n.split("_")[0] for n in found if n.startswith("op") and n[2].isdigit()} and "pipeline" in found
    assert set(entry.oracle_sql()) <= set(found)

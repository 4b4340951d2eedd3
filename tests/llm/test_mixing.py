import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumenspark.llm import mixing
from lumenspark.llm.common import ROW, identified

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """Shares again and again until none is above its limit."""
    names = sorted((k for k in sizes if k is not None), key=lambda k: [ord(c) for c in k]) + [None] * (None in sizes)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    total = sum(sizes.values())
    fixed = {}
    while True:
        rest = total - sum(fixed.values())
        share = sum(weight[k] for k in names if k not in fixed)
        over = [k for k in names if k not in fixed and rest * weight[k] / share > 3 * sizes[k]]
        if not over:
            return {k: fixed[k] if k in fixed else rest * weight[k] / share for k in names}
        fixed |= {k: 3.0 * sizes[k] for k in over}


def checked(rows, found):
    """rows: (doc_id, source, text); found: what taken() returns."""
    sizes = defaultdict(int)
    source = {}
    for k, s, t in rows:
        sizes[s] += len(WORDS.findall(t or ""))
        source[k] = s
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in found:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1, s
    assert len(found) == len(rows)


def test_permutation(spark):
    for n in (1, 2, 3, 7, 100, 1000):
        frame = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n), F.lit(5)).alias("to"))
        back = frame.withColumn("back", mixing.permuted(F.col("to"), F.lit(n), F.lit(5), inverse=True)).collect()
        assert sorted(r.to for r in back) == list(range(n)) and all(r.back == r.id for r in back)
    assert sum(r.id == r.to for r in back) < 20


def test_query(spark):
    from lumenspark.llm.queries_c import op1_mixing

    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = op1_mixing(spark, folder).collect()
    checked(rows, found)
    assert sorted(map(tuple, op1_mixing(spark, folder).collect())) == sorted(map(tuple, found))


def test_edges_and_output(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    monkeypatch.setattr(mixing, "SHARD", 4)
    monkeypatch.setattr(mixing, "CHUNK", 3)
    rows = [(1, "a", "x y"), (2, "b", " ".join(f"w{i}" for i in range(300))), (3, None, "n1\nn2  n3"), (4, "c", None), (5, "é", ""), (6, "b", "  lead\tz "), (7, "d", "q " * 40), (8, "z", "k"), (9, "c", " ")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, source string, text string, size int, start int")
    mix = mixing.Mix.of(docs, keep=["doc_id", "text"])
    found = mix.taken().collect()
    checked(rows, found)
    text = {k: t for k, _, t in rows}
    words = defaultdict(int)
    for r in mixing.Mix.of(identified(docs), keep=ROW).texts(docs, "text").collect():
        own = WORDS.findall(r.text)
        it = iter(WORDS.findall(text[r.doc_id]))
        assert own and all(w in it for w in own)  # a subsequence
        words[r.doc_id] += len(own)
        if len(own) == len(WORDS.findall(text[r.doc_id])):
            assert r.text == text[r.doc_id]
    assert sum(words.values()) == sum(r.taken for r in found) and all(words[r.doc_id] <= 3 * r.size for r in found)
    out = mix.blocks("text").collect()
    assert sum(len(WORDS.findall(r.text)) for r in out) == sum(r.taken for r in found)
    assert all(len(WORDS.findall(r.text)) <= 8 for r in out)
    twice = spark.createDataFrame([(1, "a", "x y z")] * 3 + [(None, "a", "p")], "doc_id bigint, source string, text string")
    assert sorted(r.size for r in mixing.Mix.of(twice, ["doc_id"]).taken().collect()) == [1, 3, 3, 3]
    assert mixing.Mix.of(docs.where("false"), ["doc_id"]).taken().count() == 0
    assert [r.taken for r in mixing.Mix.of(docs.where("doc_id = 4"), ["doc_id"]).taken().collect()] == [0]

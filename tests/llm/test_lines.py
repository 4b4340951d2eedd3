import hashlib
from collections import defaultdict

import numpy as np

from lumenspark.llm import lines
from lumenspark.llm.lines import CuckooFilter, LineIndex


def brute(texts, least, min_chars=1):
    def key(x):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))

    split = [(t or "").split("\n") for t in texts]
    docs = defaultdict(set)
    for i, own in enumerate(split):
        for x in own:
            docs[key(x)].add(i)
    out = []
    for own in split:
        kept = [x for x in own if len(key(x)) < min_chars or len(docs[key(x)]) < least]
        out.append(("\n".join(kept), len(own), len(own) - len(kept)))
    return out


def test_filter_finds_all_and_forgets():
    rng = np.random.default_rng(0)
    keys = rng.integers(-(2**63), 2**63 - 1, 5000)
    table = CuckooFilter.sized(len(keys))
    assert table.insert(keys) and table.holds(keys).all()
    other = rng.integers(-(2**63), 2**63 - 1, 100000)
    assert table.holds(other).mean() < 0.001
    table.delete(keys[:2500])
    assert table.holds(keys[2500:]).all() and table.holds(keys[:2500]).mean() < 0.01
    table.delete(keys[2500:])
    assert not table.table.any()


def test_insert_and_delete_are_exact(spark, monkeypatch):
    monkeypatch.setattr(lines, "COUNTER", 50)
    rng = np.random.default_rng(1)
    pool = [f"Line {i}" for i in range(80)] + ["", " ", "ÉTÉ", "été", " LINE 3\t"]
    texts = [None, "", "\n", "\n\n x"] + ["\n".join(rng.choice(pool, rng.integers(1, 12))) for _ in range(200)] + ["z " * 50000 + "\nLine 1"]
    rows = list(enumerate(texts))
    first = spark.createDataFrame(rows[:100], "doc_id bigint, text string")
    second = spark.createDataFrame(rows[100:], "doc_id bigint, text string")
    one = LineIndex.empty(spark, min_docs=10).insert(first)
    two = one.insert(second)
    for index, own, part in ((one, rows[:100], first), (two, rows, first.union(second)), (two.delete(second), rows[:100], first)):
        got = {r.doc_id: (r.kept, r.n_lines, r.n_dropped) for r in index.rewrite(part, keep=["doc_id"]).collect()}
        want = brute([t for _, t in own], 10)
        assert got == {k: w for (k, _), w in zip(own, want, strict=True)}
    assert sorted(two.delete(second).counts().select("high", "refs").collect()) == sorted(one.counts().select("high", "refs").collect())
    monkeypatch.setattr(lines, "BROADCAST", 100)  # several passes
    got = {r.doc_id: (r.kept, r.n_lines, r.n_dropped) for r in two.rewrite(first.union(second), keep=["doc_id"]).collect()}
    assert got == dict(zip([k for k, _ in rows], brute(texts, 10), strict=True))


def test_edge_rows(spark):
    docs = spark.createDataFrame([(None, "A\nb", 1), (3, "a", 2), (3, "a", 2)], "doc_id bigint, text string, kept int")
    got = LineIndex.empty(spark, min_docs=3).insert(docs).rewrite(docs, keep=["doc_id"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, "b", 2, 1), (3, "", 1, 1), (3, "", 1, 1)], key=str)
    none = docs.where("false")
    assert LineIndex.empty(spark).insert(none).rewrite(none, keep=["doc_id"]).count() == 0


def test_query(spark):
    from lumenspark.llm.queries_b import op4_line_dedup

    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = [(r.doc_id, n, d, hashlib.sha256(k.encode()).hexdigest()) for r, (k, n, d) in zip(rows, brute([r.text for r in rows], 10), strict=True)]
    assert sorted(map(tuple, op4_line_dedup(spark, folder).collect())) == sorted(want)

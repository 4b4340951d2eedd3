import hashlib
import math
import random
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from lumenspark.llm import multiset


def brute_edits(rows):
    """rows: (doc_id, text), distinct ids."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = {}
    for i, (k, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        out[k] = (len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())
    return out


def brute_print(text):
    """The number of pieces and the sum of each lane."""
    found = Counter(x.group() for x in re.finditer(multiset.PIECE, text or ""))
    lanes = [0] * multiset.LANES
    for piece, n in found.items():
        for s, seed in enumerate(multiset.SEEDS):
            h = xxhash.xxh64_intdigest(piece.encode(), xxhash.xxh64_intdigest(struct.pack("<i", seed), 42))
            for k in range(63):
                lanes[63 * s + k] += n * (h >> k & 1)
    return found.total(), [x % 2**32 for x in lanes]


def brute_likeness(a, b):
    (n, x), (m, y) = a, b
    if a == b:
        return 1.0
    u, v = [2 * i - n for i in x], [2 * i - m for i in y]
    length = math.sqrt(sum(i * i for i in u)) * math.sqrt(sum(i * i for i in v))
    return min(1.0, max(0.0, sum(i * j for i, j in zip(u, v, strict=True)) / length)) if n and m and length else 0.0


@pytest.mark.parametrize(("bucket", "bounds", "wide"), [(3, 1 << 14, 4096), (512, 1 << 14, 4096), (3, 4, 2)])
def test_edits_equal_brute_force(spark, monkeypatch, bucket, bounds, wide):
    monkeypatch.setattr(multiset, "BUCKET", bucket)
    monkeypatch.setattr(multiset, "BOUNDS", bounds)
    monkeypatch.setattr(multiset, "WIDE", wide)
    rng = random.Random(2)
    rows = [(i * i * 7 - 50, "".join(rng.choice("aé😀 \n") for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(None, "last one"), (10**15, None)]
    docs = spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id bigint, text string, n int, _bucket int")
    got = {r.doc_id: (r.n_chars, r.edited_sha256) for r in multiset.edited_fingerprints(docs).collect()}
    assert got == brute_edits(rows)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (1, "x")], "doc_id bigint, text string")
    assert multiset.edited_fingerprints(docs).count() == 3
    lone = multiset.edited_fingerprints(docs.where("text = 'x'")).collect()
    assert len(lone) == 1 and lone[0].lanes == lone[0].next_lanes
    assert multiset.edited_fingerprints(docs.where("false")).count() == 0


def test_homomorphic(spark):
    rows = spark.createDataFrame([(1, "a b\nc d\ne"), (2, "e\na b\nc d"), (3, "a b"), (4, "c d\ne"), (5, ""), (6, None), (7, "a b\nc d\nf"), (8, "w " * 300000)], "id bigint, text string")
    got = {r.id: r for r in multiset.document_fingerprints(rows, ["id"], "text").collect()}
    assert got[1][1:] == got[2][1:] and got[1].lanes != got[7].lanes and got[5].n == 0 == got[6].n
    frame = spark.createDataFrame([(got[3].lanes, got[4].lanes, got[1].lanes)], "a array<bigint>, b array<bigint>, c array<bigint>")
    r = frame.select(multiset.combined(F.col("a"), F.col("b")).alias("whole"), multiset.combined(F.col("c"), F.col("b"), -1).alias("part")).first()
    assert r.whole == got[1].lanes and r.part == got[3].lanes
    assert got[8].n == 37500


def test_many_nulls_keep_one_chain(spark):
    rows = [(None, f"text number {i} of the loose ones") for i in range(60)] + [(i, f"line {i}") for i in range(5)]
    got = multiset.edited_fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    own, after = Counter(tuple(r.lanes) for r in got), Counter(tuple(r.next_lanes) for r in got)
    assert len(got) == 65 and own == after  # each row is the next of one other


def test_long_repeats(spark):
    many, short = "b\n" * 65536, "some other words here"
    rows = [(1, many), (2, short), (3, "b\n" * 32768), (4, "b\n" * 32767), (5, "b\n" * (1 << 21)), (6, "c d\n" * 70000 + "e f\n" * 70000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = multiset.edited_fingerprints(docs)
    got = {r.doc_id: r for r in found.select("*", multiset.likeness(F.col("lanes"), F.col("n"), F.col("next_lanes"), F.col("next_n")).alias("near_next")).collect()}
    for k, t in rows:
        assert (got[k].n, got[k].lanes) == brute_print(t)
    assert got[4].near_next == pytest.approx(1.0) and got[2].near_next == pytest.approx(brute_likeness(brute_print(short), brute_print(many)))
    assert got[6].near_next == pytest.approx(brute_likeness(brute_print(rows[5][1]), brute_print(rows[4][1])))


def test_query(spark):
    from lumenspark.llm.queries_c import op9_fingerprints

    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want, text = brute_edits(rows), dict(rows)
    got = op9_fingerprints(spark, folder).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want
    order = sorted(rows, reverse=True)
    prints = {k: brute_print(t) for k, t in rows}
    written = lambda p: f"{p[0]:016x}" + "".join(f"{x:08x}" for x in p[1])
    by_id = {r.doc_id: r for r in got}
    for i, (k, t) in enumerate(order):
        after = order[(i + 1) % len(order)]
        half = len(t) // 2
        edited = brute_print(t[: len(t) - half] + after[1][:half])
        r = by_id[k]
        assert (r.fingerprint, r.edited_fingerprint) == (written(prints[k]), written(edited))
        assert r.near_edited == pytest.approx(brute_likeness(prints[k], edited), abs=1e-12) and r.near_next == pytest.approx(brute_likeness(prints[k], prints[after[0]]), abs=1e-12)
    prints = {}
    for r in got:
        assert prints.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    long = [r for r in got if r.n_chars > 400]
    mean = lambda xs: sum(xs) / len(xs)
    assert 0.4 < mean([r.near_edited for r in long]) < 0.6 and mean([r.near_next for r in long]) < 0.15
    assert len(set(prints.values())) == len(prints)

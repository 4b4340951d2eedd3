import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenspark.llm import components, simhash


def brute_fingerprint(text, width):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(keys, fps, bits):
    n = len(fps)
    label = list(range(n))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    fps = np.array(fps, np.uint64)
    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= bits):
            label[max(root(i), root(int(j)))] = min(root(i), root(int(j)))
    least = {}
    for i in range(n):
        least[root(i)] = min(least.get(root(i), keys[i]), keys[i])
    return [least[root(i)] for i in range(n)]


@pytest.mark.parametrize("bits", [4, 7])
def test_links_equal_brute_force(spark, bits):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    fps = list(base)
    for x in base[:120]:
        for _ in range(rng.integers(1, 6)):
            y = int(x)
            for p in rng.choice(64, rng.integers(1, 9), replace=False):
                y ^= 1 << int(p)
            fps.append(y)
    fps = sorted({int(x) for x in fps})
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    rows = spark.createDataFrame([(x, [x]) for x in signed], "node bigint, fp array<bigint>")
    found = {r.node: r.root for r in components.components(simhash.fingerprint_links(rows, bits)).collect()}
    assert [found.get(x, x) for x in signed] == brute_components(signed, fps, bits)


def test_hot_anchor_cells(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(simhash, "CELL", 16)
    fps = sorted({int(x) for x in np.uint64(7 << 40) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64))})
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    rows = spark.createDataFrame([(x, [x]) for x in signed], "node bigint, fp array<bigint>")
    found = {r.node: r.root for r in components.components(simhash.fingerprint_links(rows, 4)).collect()}
    assert [found.get(x, x) for x in signed] == brute_components(signed, fps, 4)


def test_query_equals_brute_force(spark):
    from lumenspark.llm.queries_a import op3_simhash

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text, 4) for r in rows]
    assert fps[:20] == [simhash.fingerprint((r.text or "").encode(), 4)[0] for r in rows[:20]]
    keys = [r.doc_id for r in rows]
    want = sorted(zip(keys, [f"{x:016x}" for x in fps], brute_components(keys, fps, 4), strict=True))
    assert sorted(map(tuple, op3_simhash(spark, folder).collect())) == want


def test_edge_rows(spark):
    docs = spark.createDataFrame([(5, None, "x"), (4, "", "y"), (None, " \n", "z"), (9, "One two", None), (8, "one TWO", "a"), (8, "one TWO", "a"), (2, "word " * 30000, "b")], "doc_id bigint, text string, fp string")
    found = sorted(map(tuple, simhash.near_duplicates(docs, width=4, bits=4).select("doc_id", "component_id").collect()), key=str)
    assert found == sorted([(5, 4), (4, 4), (None, 4), (9, 8), (8, 8), (8, 8), (2, 2)], key=str)
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = components.components(edges).collect()
    assert len(found) == 201 and {r.root for r in found} == {0}


def test_deduplicated_keeps_one_of_each_group(spark):
    rng = np.random.default_rng(8)
    rows, group = [], []
    for g in range(150):
        words = [f"w{rng.integers(0, 5000)}" for _ in range(rng.integers(60, 400))]
        for c in range(1 + g % 4):
            own = list(words)
            for at in rng.choice(len(own), 1 + len(own) // 120, replace=False) if 0 < c < 3 else []:
                own[at] = f"x{rng.integers(0, 5000)}"
            rows.append((1000 - len(rows), " ".join(own), "s"))
            group.append(g)
    rows += [(5000, "", "s"), (5001, None, "s"), (5002, " ", "s"), (5003, "lone", "s"), (5003, "lone", "s"), (None, "no key", "s"), (None, rows[0][1], "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    least = {}
    for (k, _, _), g in zip(rows, group, strict=False):
        least[g] = min(least.get(g, k), k)
    want = set(least.values()) | {5000, 5003, None}
    assert len(got) == len(set(got)) and want <= set(got) and len(set(got) - want) <= 6
    assert simhash.deduplicated(docs.where("false")).count() == 0


def test_wide_recall_at_similarity(spark):
    rng = np.random.default_rng(9)
    hits = 0
    for _ in range(300):  # two sets that share 0.8 of their elements
        both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (400, 50, 50))
        x, y = ([simhash.majority(simhash.mixed(np.concatenate([both, z]), k)) for k in range(simhash.WORDS)] for z in (a, b))
        apart = sum((p ^ q).bit_count() for p, q in zip(x, y, strict=True))
        met = any(((x[w] ^ y[w]) >> first & ((1 << n) - 1)).bit_count() <= 1 for w, first, n in simhash.block_places(simhash.WORDS, simhash.BLOCKS))
        hits += apart <= simhash.BITS and met
    assert hits / 300 > 0.95, hits


def test_deduplicated_verifies_similarity(spark):
    rng = np.random.default_rng(11)
    rows, want = [], set()
    for g in range(120):  # a run of words of the second text is other: about 0.72 or 0.85 of the shingles are shared
        words = [f"w{rng.integers(0, 10**6)}" for _ in range(204)]
        own = list(words)
        for at in range(50, 50 + (28 if g % 2 else 12)):
            own[at] = f"x{rng.integers(0, 10**6)}"
        sets = [{tuple(w[i : i + 5]) for i in range(200)} for w in (words, own)]
        share = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        assert share < 0.75 if g % 2 else share > 0.83
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(own))]
        want |= {2 * g, 2 * g + 1} if g % 2 else {2 * g}
    got = [r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert len(got) == len(set(got)) and want <= set(got) and len(set(got) - want) <= 2


def test_groups_emit_forests_not_pairs(spark, monkeypatch):
    rng = np.random.default_rng(13)
    sets, lines = [], rng.integers(0, 2, 90)
    base = rng.integers(0, 2**63, 100, dtype=np.uint64)
    for i in range(90):  # thirds of equal sets but for a few, of sets that share 0.7 with each other, and of none
        new = rng.integers(0, 2**63, 100, dtype=np.uint64)
        sets.append(np.unique(np.concatenate([base[: 100 - (4, 17, 100)[i % 3]], new[: (4, 17, 100)[i % 3]]])).view(np.int64))
    share = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    fp = np.array([[simhash.majority(simhash.mixed(x.view(np.uint64), k)) for k in range(4)] for x in sets], np.uint64)
    node, sizes, flat = np.arange(90), np.array([len(x) for x in sets]), np.concatenate(sets)
    for line in (np.full(90, 2), lines):
        a, b = simhash.verified(node, line, fp, sizes, flat, 256, 0.8)
        want = [(i, j) for i in range(90) for j in range(i) if share(sets[i], sets[j]) >= 0.8 and (line[i] == 2 or line[i] != line[j])]
        same = lambda edges: simhash.forest(*map(np.array, zip(*edges, strict=True)))
        assert len(a) < 90 and [x.tolist() for x in same(zip(a, b, strict=True))] == [x.tolist() for x in same(want)]


def test_groups_dealt_to_cells(spark, monkeypatch):
    rng = np.random.default_rng(14)
    base = [f"w{rng.integers(0, 10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):
        own = list(base)
        own[10 + i : 10 + i + (2 if i % 2 else 40)] = [f"x{i}y{k}" for k in range(2 if i % 2 else 40)]
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = sorted(r.doc_id for r in simhash.deduplicated(docs, bits=256, blocks=16).collect())
    monkeypatch.setattr(simhash, "SHINGLES", 700)
    assert sorted(r.doc_id for r in simhash.deduplicated(docs, bits=256, blocks=16).collect()) == whole
    monkeypatch.setattr(simhash, "MEMBERS", 4)
    assert sorted(r.doc_id for r in simhash.deduplicated(docs, bits=256, blocks=16).collect()) == whole
    assert whole == [i for i in range(60) if i % 2 == 0 or i == 1]

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
import tiktoken
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    """Rows before and after each stage."""
    from lumenspark.llm.common import stored

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), name)
        out.append(docs)
    return out


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[1:-1])
    assert all(s.schema["n_chars"].dataType == steps[0].schema["n_chars"].dataType for s in steps[1:-1])


def test_toxic_go_and_clean_stay(spark, steps):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[1].select("doc_id").collect()}
    clean = [k for k, y in labels.items() if y == 0]
    toxic = [k for k, y in labels.items() if y == 1]
    assert sum(k in kept for k in clean) / len(clean) > 0.98 and sum(k in kept for k in toxic) / len(toxic) < 0.4  # a few dozen examples in four languages
    before = {r.doc_id: r.text for r in steps[0].collect()}
    assert all(before[r.doc_id] == r.text for r in steps[1].collect())


def test_shared_lines_go(steps):
    blank = " \t\n\x0b\x0c\r"
    rows = steps[1].collect()
    count = Counter(k for t in {r.text or "" for r in rows} for k in {x.strip(blank).lower() for x in t.split("\n")} if k)
    want = {r.doc_id: "\n".join(x for x in (r.text or "").split("\n") if count[x.strip(blank).lower()] < 10) for r in rows}
    assert {r.doc_id: r.text for r in steps[2].collect()} == want


def test_near_duplicates_go_and_others_stay(steps):
    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    before = {r.doc_id: shingles(r.text) for r in steps[2].collect()}
    kept = {r.doc_id for r in steps[3].collect()}
    by_shingle = defaultdict(list)
    for k, s in before.items():
        for x in s:
            by_shingle[x].append(k)
    pairs = {(a, b) for own in by_shingle.values() if len(own) < 60 for a in own for b in own if a < b}
    close = {(a, b): len(before[a] & before[b]) / len(before[a] | before[b]) for a, b in pairs}
    equal = [p for p, j in close.items() if j == 1]
    near = [p for p, j in close.items() if 0.8 <= j < 1]
    assert not [p for p in equal if kept >= set(p)]
    assert sum(kept >= set(p) for p in near) <= 0.15 * len(near)
    apart = set(before) - {k for p, j in close.items() if j >= 0.6 for k in p}
    assert {k for k in apart if any(before[k] - {()})} <= kept


def test_mix_and_tokens(steps):
    import public_tokenizers

    from lumenspark.llm.bpe import read_ranks

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    before = {r.doc_id: (r.text or "").split() for r in steps[3].collect()}
    size, got, times = Counter(), Counter(), Counter()
    for r in steps[3].collect():
        size[r.source] += len((r.text or "").split())
    rows = steps[4].collect()
    for r in rows:
        got[r.source] += len(r.text.split())
        times[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert sum(got.values()) == pytest.approx(sum(size.values()), rel=0.001) and all(times[k] <= 3 * len(before[k]) for k in times)
    want = Counter()
    for r in rows:
        ids = library.encode_ordinary(r.text)
        want[(r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())] += 1
    last = steps[5].collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in last) == want and all(len(r.ids) == r.n_tokens for r in last)


def test_edge_rows(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "a", 0), (2, "x " * 40000, "en", "a", 80000), (3, "x " * 40000, None, "b", None), (None, "odd one out", "en", None, 3)]
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for part, name in ((rows, "some"), ([], "none")):
        docs = spark.createDataFrame(part, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        got = docs.collect()
        assert {r.doc_id for r in got} == ({2, None} if part else set()), name
    more = spark.createDataFrame([(4, "some words here", "en", "a", 1, 0.5, 7, 8, "s", "k", 1, 2, 3, "d", "c", "w", "t")], schema + ", score double, size int, fp int, _score string, _kept string, _d0 int, _d1 int, _copy int, _data string, _first string, _whole string, _tokens string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        more = stage(spark, more, str(tmp_path))
    assert more.columns[5:8] == ["score", "size", "fp"] and [r.text for r in more.collect()] == ["some words here"]
    assert [tuple(r)[5:] for r in more.collect()] == [(0.5, 7, 8, "s", "k", 1, 2, 3, "d", "c", "w", "t")]

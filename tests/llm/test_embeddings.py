import numpy as np

from lumenspark.llm import embeddings


def brute(rows, least):
    good = [i for i, (k, v, lab) in enumerate(rows) if k is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root = {k: k for k, _, _ in rows}
    links = [0] * len(rows)

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for n, i in enumerate(good):
        for j in good[n + 1 :]:
            (a, x, p), (b, y, q) = rows[i], rows[j]
            if p == q and len(x) == len(y):
                x, y = np.array(x, float), np.array(y, float)
                if (x == y).all() or x @ y / np.sqrt(x @ x * (y @ y)) >= least:
                    links[i] += 1
                    links[j] += 1
                    if a != b:
                        a, b = top(a), top(b)
                        root[max(a, b)] = min(a, b)
    return [(k, links[i], top(k), k is not None and top(k) == k) for i, (k, _, _) in enumerate(rows)]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 40)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = []
    for c in range(60):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 6)):
            rows.append((len(rows), [float(np.float32(x)) for x in base + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.2])], int(rng.choice([1, 1, 1, 2]))))
    for v, lab in ((None, 1), ([], 1), ([0.0] * 16, 1), ([None] + [1.0] * 15, 1), ([float("nan")] + [1.0] * 15, 1), ([float("inf")] + [1.0] * 15, 2), (rows[0][1], None), (rows[0][1][:8], rows[0][2])):
        rows.append((len(rows), v, lab))
    rows.append(rows[3])
    rows.append((None, rows[3][1], rows[3][2]))
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, label int, tiles int")
    got = embeddings.near_duplicates(frame, least=0.98).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows, 0.98), key=str)
    assert embeddings.near_duplicates(frame.where("false")).count() == 0


def test_bound_holds():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 64)) * rng.exponential(size=(1, 64)) ** 3
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, left = embeddings.quantised(x)
    error = np.abs(x @ x.T - (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None, :])
    assert (error <= left[:, None] + (1 + left[:, None]) * left[None, :]).all()


def test_query(spark):
    from lumenspark.llm.queries_a import op8_embeddings

    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op8_embeddings(spark, folder).collect())) == sorted(brute(rows, 0.98))

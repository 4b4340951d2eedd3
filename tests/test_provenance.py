import hashlib

import numpy as np
import pytest
from test_detection import brute, frames, random_case
from pyspark.sql import functions as F

from lumenspark.functions.color import Colorimetry
from lumenspark.operators import detection as D
from lumenspark.operators import evidence
from lumenspark.operators import provenance as P
from lumenspark.operators.frames import Profile


def test_models_as_rows_and_records(spark):
    parts = [("b.bin", b"two"), ("a.bin", b""), ("é", b"three")]
    rows = spark.createDataFrame([("m", n, d) for n, d in parts] + [("other", "x", None)], "model string, file string, data binary")
    own = rows.withColumn("data", F.col("data")).select("model", "file", "data")
    named = P.artifacts(own, "file", "data").join(own.select("model", F.col("file").alias("name")), "name")
    got = {r.model_id: r for r in P.models(named, "model", "local").collect()}
    record = P.model_record("local", "m", [P.described(n, d) for n, d in parts])
    assert got["m"].model_sha256 == record["model_sha256"] and got["m"].artifacts == 3
    assert got["other"].model_sha256 == P.model_record("local", "other", [P.described("x", b"")])["model_sha256"]
    assert P.is_model(record) and not P.is_model({**record, "revision": "r"}) and not P.is_model({**record, "more": 1})
    for bad in ([], [P.described("x", b"")] * 2, [{"name": "x", "bytes": -1, "sha256": "0" * 64}], [{"name": "x", "bytes": 1, "sha256": "F" * 64}]):
        with pytest.raises(ValueError):
            P.model_record("local", "m", bad)


def test_files_and_drift(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "one").write_bytes(b"1")
    (tmp_path / "deep/two").write_bytes(b"22")
    found = P.files(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [("deep/two", 2, hashlib.sha256(b"22").hexdigest()), ("one", 1, hashlib.sha256(b"1").hexdigest())]
    want = spark.createDataFrame([("one", 1, "0" * 64), ("gone", 0, "0" * 64)], "name string, bytes bigint, sha256 string")
    assert sorted(map(tuple, P.drift(found, want).collect())) == [("changed", "one"), ("missing", "gone"), ("unexpected", "deep/two")]
    assert P.drift(found, found).count() == 0
    one = P.described_file(tmp_path / "one")
    assert P.same_artifact(one, P.described("one", b"1")) == one
    with pytest.raises(RuntimeError):
        P.same_artifact(one, P.described("one", b"2"))


def test_executions_and_results():
    model = P.model_record("local", "m", [P.described("x", b"")])
    device, inference = {"method": "spelled", "matches": True}, {"method": "seeded", "attested": True}
    record = P.execution_record(model, "own", "cuda", "cuda:1", device, inference)
    assert P.is_execution(record, model) and not P.is_execution({**record, "implementation_id": "x"})
    for args in (("own", "cuda:0", "cuda:1", device, inference), ("", "cpu", "cpu", device, inference), ("own", "cpu", "cpu", {"method": "m", "matches": False}, inference)):
        with pytest.raises(ValueError):
            P.execution_record(model, *args)
    runtime = P.runtime_record()
    result = P.result_record({"study": "s"}, {"map50": 0.5}, runtime)
    assert P.is_result(result) and not P.is_result({**result, "metrics": {"map50": 0.6}})
    assert P.array_sha256([1, 2]) == P.array_sha256(np.array([1.0, 2.0], ">f4")) != P.array_sha256([[1, 2]]) != P.array_sha256([1j, 2])


def test_colorimetry():
    assert sum(Colorimetry().weights) == pytest.approx(1)
    for bad in ({"name": " "}, {"weights": (0.5, 0.5, 0.0)}, {"weights": (0.5, 0.4, 0.2)}, {"white": (0.9, 0.2)}):
        with pytest.raises(ValueError):
            Colorimetry(**bad)


def test_match_grid(spark):
    rows = evidence.match_grid(spark, Profile(), (0.5, 2.0)).collect()
    assert len(rows) == 6 and all(r.relative_error <= 0.005 for r in rows)
    by = {(r.family, r.waves): r for r in rows}
    assert all(by[(f, 0.5)].target_mtf50 > by[(f, 2.0)].target_mtf50 for f in ("gaussian", "quadratic_cosine", "sampled_incoherent"))
    assert by[("gaussian", 0.5)].parameter < by[("gaussian", 2.0)].parameter
    with pytest.raises(ValueError):
        evidence.match_grid(spark, Profile(), (1.0, 1.0))


def test_grid_gaps(spark):
    images = spark.createDataFrame([(1,), (2,)], "image_id bigint")
    records = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (3, 1)], "image_id bigint, realization int")
    assert sorted(map(tuple, D.grid_gaps(records, images, (0, 1)).collect())) == [("duplicate", 2, 0), ("missing", 2, 1), ("unexpected", 3, 1)]


def test_hierarchical_equals_loops(spark):
    gt, first = random_case(5)
    second = [r for r in random_case(5)[1] if r[2] % 3]
    g, _ = frames(spark, gt, first)
    packed = [D.matches(g, frames(spark, gt, d)[1], areas={"all": D.AREAS["all"]}).withColumn("realization", F.lit(r)) for r, d in ((4, first), (9, second))]
    ids = sorted({r[0] for r in gt} | {r[0] for r in first})
    images = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "image_id bigint, ordinal int")
    got = {(r.stream, r.metric): (r.estimate, r.half_width) for r in D.hierarchical(packed[0].unionByName(packed[1]), images, (4, 9), 4, 11).collect()}

    def metric(slots, det):
        again = lambda rows: [(k, *r[1:]) for k, s in enumerate(slots) for r in rows if r[0] == ids[s]]
        a, b = again(gt), again(det)
        ap = {(t, c): brute([r for r in a if r[1] == c], [r for r in b if r[1] == c], t, *D.AREAS["all"])[0] for t in D.THRESHOLDS for c in (1, 2)}
        mean = lambda x: float(np.mean([v for v in x if v >= 0])) if any(v >= 0 for v in x) else -1.0
        return np.array([mean([v for (t, _), v in ap.items() if t == 0.5]), mean(list(ap.values()))])

    every, dets = np.arange(len(ids)), (first, second)
    points = [metric(every, d) for d in dets]
    samples = {"image": [], "realization": [], "joint": []}
    for stream, into in samples.items():
        for slots, turns in D.stream_draws(len(ids), 2, 4, 11, stream):
            each = [metric(slots if slots is not None else every, dets[t]) for t in (turns if turns is not None else (0, 1))]
            into.append(np.mean(each, axis=0))
    for stream, values in samples.items():
        for i, name in enumerate(("map50", "map50_95")):
            assert got[(stream, name)] == pytest.approx((np.mean(points, axis=0)[i], 1.96 * np.std([v[i] for v in values], ddof=1)), abs=1e-9)

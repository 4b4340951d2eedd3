import json

import numpy as np
import pytest

from lumenspark.__main__ import main
from lumenspark.operators import conditions as C
from lumenspark.operators import evidence, execution
from lumenspark.operators import frames as R
from lumenspark.sources import publication, shards

B = C.Binding("0" * 64)


def test_conditions():
    w = C.Condition(B, "physical_defocus", 1.5)
    p = C.Condition(B, "photon_loss", 2.0)
    both = C.Condition(B, "factorial", parts=(w, p))
    for c in (w, p, both, C.Condition(B, "baseline", kind="modeled_neutral"), C.Condition(B, "mechanism_comparator", 0.7, "gaussian")):
        assert C.parsed(json.loads(json.dumps(c.record()))) == c and C.parsed(c.record()).sha256 == c.sha256
    s = both.severity()
    assert (s.waves, s.stops, s.through_sensor) == (1.5, 2.0, True) and C.Condition(B, "baseline", kind="untouched_input").severity() is None
    for bad in (("factorial", None, None, (p, w)), ("factorial", None, None, (w,)), ("baseline", 1.0, "modeled_neutral", ()), ("photon_loss", None, None, ()), ("unknown", 1.0, None, ())):
        with pytest.raises(ValueError):
            C.Condition(B, *bad)
    with pytest.raises(ValueError):
        C.parsed(w.record() | {"more": 1})
    assert C.parse_grid("0.5,1,3") == (0.5, 1.0, 3.0)
    for bad in ("1,1", "nan", "inf", "x"):
        with pytest.raises(ValueError):
            C.parse_grid(bad)


def test_evidence_passes(spark):
    rows = evidence.report(spark, R.Profile()).collect()
    assert {r.metric for r in rows} == set(evidence.TOLERANCE)
    assert all(r.passed for r in rows), [r for r in rows if not r.passed]


def test_run_resume_and_analyze(spark, tmp_path):
    def bright(images):
        """A detector of the bright block."""
        out = []
        for image in images:
            y, x = np.nonzero(image[..., 0] > 0.6)
            out.append({"boxes": [[x.min(), y.min(), x.max() + 1, y.max() + 1]] * 2 if len(x) else [], "labels": [3, 3] if len(x) else [], "scores": [0.9, 0.0001] if len(x) else []})
        return out

    image = np.full((16, 20, 3), 0.1)
    image[2:6, 2:10] = 0.9
    frames = spark.createDataFrame([(i, 16, 20, 3, image.ravel().tolist(), k) for k, i in enumerate((4, 7, 9))], f"{R.SCHEMA}, ordinal int")
    folder = f"{tmp_path}/shards"
    condition = C.Condition(B, "baseline", kind="untouched_input")
    one = execution.run_condition(frames, R.Profile(), condition, bright, folder, execution.shard_name("d", "primary", "untouched_input"), shard=2, side=40)
    assert [r["rows"] for r in one] == [2, 1]

    def never(images):
        raise AssertionError("it was there")

    assert execution.run_condition(frames, R.Profile(), condition, never, folder, "d-primary-untouched_input", shard=2, side=40) == one
    found = shards.detections(shards.read(spark, f"{folder}/*.gz*")).collect()
    assert sorted(r.image_id for r in found) == [4, 7, 9] and all(np.allclose((r.x1, r.y1, r.x2, r.y2), (2, 2, 10, 6), atol=0.51) for r in found)
    tree = {"images": [{"id": i, "file_name": f"{i}", "height": 16, "width": 20} for i in (4, 7, 9)], "annotations": [{"id": i, "image_id": i, "category_id": 3, "bbox": [2, 2, 8, 4], "area": 32.0} for i in (4, 7, 9)], "categories": [{"id": 3, "name": "box"}]}
    (tmp_path / "a.json").write_text(json.dumps(tree))
    assert main(["analyze", f"{tmp_path}/a.json", folder, f"{tmp_path}/out"]) == 0
    lines = publication.published(f"{tmp_path}/out")["points.csv"].decode().splitlines()
    assert lines[0] == "metric,category_id,value" and any(x.startswith("map50,,0.99") or x == "map50,,1" for x in lines)


def test_best_is_stable():
    got = execution.best({"boxes": [[i, 0, i + 1, 1] for i in range(101)], "labels": [1] * 101, "scores": np.linspace(0.001, 0.999, 101)})
    assert len(got["scores"]) == 100 and got["scores"] == sorted(got["scores"], reverse=True) and min(got["scores"]) > 0.001


def test_plan_command(capsys, spark):
    assert main(["plan"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 67

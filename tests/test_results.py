import json

import numpy as np
import pytest

from lumenspark.operators import results as R


def test_pipeline_runs_and_knows_itself(spark):
    frames = spark.createDataFrame([(i, 2, 2, 1, [0.1 * i, 0.2, 0.3, 0.4]) for i in range(1, 4)], "image_id bigint, height int, width int, channels int, data array<double>")
    stages = (R.Stage("decode", "display_rgb", "linear_rgb_proxy", lambda _, x: x * 2, (("gamma", 2),)), R.Stage("grid", "linear_rgb_proxy", "source_grid_linear_rgb", lambda k, x: x + k))
    line = R.Pipeline("ldr", stages)
    got = {r.image_id: r.data for r in line.run(frames).collect()}
    assert got[2] == pytest.approx([2.4, 2.4, 2.6, 2.8])
    assert {r.image_id: r.data for r in line.trace(frames)["decode"].collect()}[1] == pytest.approx([0.2, 0.4, 0.6, 0.8])
    record = json.loads(line.provenance_json())
    assert [s["name"] for s in record["stages"]] == ["decode", "grid"] and record["stages"][0]["parameters"] == {"gamma": 2}
    assert line.provenance_json() != R.Pipeline("ldr", stages[:1]).provenance_json()
    with pytest.raises(ValueError):
        R.Pipeline("ldr", stages[::-1])
    with pytest.raises(ValueError):
        R.Pipeline("forward", stages)


def test_coordinates_meet():
    there = R.source_to_sensor((16, 20), (8, 10))
    assert np.allclose(there @ [0.5, 0.5, 1], [0, 0, 1]) and np.allclose(there @ [18.5, 14.5, 1], [9, 7, 1])
    shift = np.array([[1, 0, 1.0], [0, 1, 0], [0, 0, 1]])
    assert np.allclose(R.homography_on_source(shift, (16, 20), (8, 10)), [[1, 0, 2], [0, 1, 0], [0, 0, 1]])


def test_profiles():
    p = R.profiles()
    assert len(p) == 4
    ratio = [x.f_number * x.reference / x.pitch for x in (p["ldr_native"], p["ldr_native_replication"])]
    assert ratio[1] == pytest.approx(2 * ratio[0])


def test_csv_of_results(spark):
    from lumenspark.plans import results as Q

    data = R.secondary_csv(Q.secondary_results(spark, "/root/testdata/sf0.001"))
    assert data.decode().split("\n")[0] == ",".join(R.SECONDARY) and data.count(b"false") == data.count(b"\n") - 1
    assert R.primary_csv(Q.primary_results(spark, "/root/testdata/sf0.001")).decode().split("\n")[0] == ",".join(R.PRIMARY)

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspark.operators import frames as R
from lumenspark.sources import coco, publication, shards
from lumenspark.streaming import incremental


def test_annotations(spark, tmp_path):
    image = np.zeros((16, 20), np.uint8)
    image[2:6, 2:10] = 200
    tree = {"images": [{"id": i, "file_name": f"{i}.pgm", "height": 16, "width": 20} for i in (9, 4, 7)], "annotations": [{"id": 1, "image_id": 4, "category_id": 3, "bbox": [2, 2, 8, 4], "area": 32.0}, {"id": 2, "image_id": 9, "category_id": 3, "bbox": [2, 2, 0, 4], "area": 0.0}], "categories": [{"id": 3, "name": "box"}]}
    (tmp_path / "a.json").write_text(json.dumps(tree, indent=1))
    (tmp_path / "img").mkdir()
    for i in (4, 7, 9):
        (tmp_path / "img" / f"{i}.pgm").write_bytes(b"P5\n20 16\n255\n" + image.tobytes())
    got = coco.read_annotations(spark, f"{tmp_path}/a.json")
    assert [(r.image_id, r.ordinal) for r in got.images.orderBy("ordinal").collect()] == [(4, 0), (7, 1), (9, 2)]
    assert [tuple(r)[:9] for r in got.gt.collect()] == [(4, 3, 1, 2.0, 2.0, 10.0, 6.0, 32.0, 0)] and got.dropped.first()[0] == 1
    assert [r.image_id for r in coco.read_annotations(spark, f"{tmp_path}/a.json", offset=1, limit=1).images.collect()] == [7]
    assert {r.image_id: r.ordinal for r in coco.read_annotations(spark, f"{tmp_path}/a.json", ordered=[9, 4]).images.collect()} == {9: 0, 4: 1}
    with pytest.raises(ValueError):
        coco.read_annotations(spark, f"{tmp_path}/a.json", ordered=[5])
    made = coco.decoded(coco.image_files(spark, f"{tmp_path}/img", got.images))
    rows = made.collect()
    assert len(rows) == 3 and np.allclose(np.array(rows[0].data).reshape(16, 20), image / 255) and made.schema.simpleString() == spark.createDataFrame([], R.SCHEMA).schema.simpleString()


def test_shards(spark, tmp_path):
    study = {"detector": "d", "arm": "physical_w_0p5"}
    predictions = {i: {"boxes": [[1.0, 2.0, 3.0, 4.0 + i]], "labels": [1], "scores": [0.5]} for i in (3, 5, 8)}
    head = shards.header(study, [3, 5, 8])
    one = shards.write(tmp_path / "a.jsonl.gz", head, predictions)
    assert shards.write(tmp_path / "a.jsonl.gz", head, predictions) == one  # the same again is no work
    with pytest.raises(FileExistsError):
        shards.write(tmp_path / "a.jsonl.gz", head, {i: {"boxes": [], "labels": [], "scores": []} for i in (3, 5, 8)})
    shards.write(tmp_path / "b.jsonl.gz", shards.header(study, [9]), {9: {"boxes": [], "labels": [], "scores": []}})
    rows = shards.read(spark, str(tmp_path))
    assert sorted((r.image_id, r.ordinal) for r in rows.collect()) == [(3, 0), (5, 1), (8, 2), (9, 0)]
    assert sorted((r.image_id, r.y2) for r in shards.detections(rows).collect()) == [(3, 7.0), (5, 9.0), (8, 12.0)]
    (tmp_path / f"b.jsonl.gz{shards.RECEIPT}").unlink()
    with pytest.raises(ValueError):
        shards.existing(tmp_path / "b.jsonl.gz")
    with pytest.raises(Exception, match="half published"):
        shards.read(spark, str(tmp_path)).count()
    data = bytearray((tmp_path / "a.jsonl.gz").read_bytes())
    data[-1] ^= 1
    (tmp_path / "a.jsonl.gz").write_bytes(data)
    with pytest.raises(ValueError):
        shards.existing(tmp_path / "a.jsonl.gz")


def test_publication(spark, tmp_path):
    rows = spark.createDataFrame([("b", 0.1, None), ("a", 1.0, True)], "k string, v double, f boolean")
    data = publication.csv_bytes(rows, ["k"])
    assert data == b"k,v,f\na,1,true\nb,0.10000000000000001,\n"
    one = publication.publish(tmp_path, {"points.csv": data}, {"plan": 1})
    assert publication.publish(tmp_path, {"points.csv": data}, {"plan": 1}) == one and publication.published(tmp_path) == {"points.csv": data}
    with pytest.raises(FileExistsError):
        publication.publish(tmp_path, {"points.csv": data + b"x"}, {"plan": 1})


def test_streams(spark, tmp_path):
    source = tmp_path / "events"
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table.repartition(3, "user_id").write.parquet(str(source))

    def run(frame, name, mode="append"):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    events = incremental.read_events(spark, str(source), files=10)
    got = run(incremental.tumbling(events), "days")
    want = table.withColumn("start", F.date_trunc("day", F.col("ts").cast("timestamp"))).groupBy("start", "event_type").agg(F.count(F.lit(1)).alias("n"))
    days = {(r.start, r.event_type): r.n for r in want.collect()}
    seen = {(r.start, r.event_type): r.n for r in got.collect()}
    assert seen and all(days[k] == n for k, n in seen.items()) and len(days) - len(seen) <= 10  # the last days stay open
    users = run(incremental.sessions(events), "runs").collect()
    assert users and all(r.end > r.start and r.n > 0 for r in users)
    assert run(incremental.first_seen(events, ["event_id"]), "once").count() == table.count()
    rows = incremental.read_events(spark, str(source), files=1)
    for _ in range(2):  # a second run finds nothing left to do
        q = incremental.write_pieces(rows, lambda b: b.select("event_id"), f"{tmp_path}/out", f"{tmp_path}/ck")
        q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == table.count() and spark.read.parquet(f"{tmp_path}/out").select("batch").distinct().count() == 3

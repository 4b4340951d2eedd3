"""Queries look at all rows of their tables."""

import duckdb

from lumenspark.plans import analytics, composite, planning

FOLDER = "/root/testdata/sf0.001"


def rows(sql):
    made = duckdb.connect()
    for t in ("lineitem", "orders", "embeddings"):
        made.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return sorted(made.execute(sql).fetchall())


def test_boxes_are_all_line_items(spark):
    gt, det = composite._boxes(spark, FOLDER)
    assert [(gt.count(), det.count())] == rows("select count(*), count(*) filter (where l_partkey % 10 <> 3) from lineitem")


def test_detection_problems_of_all_line_items(spark):
    sql = composite.ORACLE_SQL["detection_problems"]
    assert "% 50" not in sql
    got = composite.detection_problems(spark, FOLDER).select("problem", "n").collect()
    assert sorted(map(tuple, got)) == rows(sql)


def test_bootstrap_draws_all_images(spark, monkeypatch):
    seen = []

    def bootstrap(matched, images, replicates, seed, arm="arm"):
        seen.append((images.count(), replicates))
        return matched

    monkeypatch.setattr(composite.detection, "bootstrap", bootstrap)
    monkeypatch.setattr(composite.detection, "paired_intervals", lambda replicates, points, baseline: points)
    composite.paired_bootstrap(spark, FOLDER)
    assert seen == [(rows("select count(distinct l_orderkey) from lineitem")[0][0], 2000)]


def test_iou_pairs_of_all_line_items(spark):
    sql = analytics.ORACLE_SQL["iou_pairs"]
    assert "% 40" not in sql
    want = rows(sql)
    got = sorted(map(tuple, analytics.iou_pairs(spark, FOLDER).select("l_suppkey", "id", "other", "iou").collect()))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert max(abs(g[3] - w[3]) for g, w in zip(got, want, strict=True)) < 2e-7


def test_stage_graph_of_all_orders(spark):
    sql = planning.ORACLE_SQL["stage_graph"]
    # illegal stages come of multiples of 70 and 110; the stages of all other orders are looked at as well
    seen = []
    real = planning.study.illegal_stages
    planning.study.illegal_stages = lambda stages, legal: seen.append(stages) or real(stages, legal)
    try:
        got = sorted(map(tuple, planning.stage_graph(spark, FOLDER).select("pipeline", "idx", "problem").collect()))
    finally:
        planning.study.illegal_stages = real
    assert got == rows(sql)
    assert [(seen[0].select("pipeline").distinct().count(),)] == rows("select count(distinct o_orderkey) from orders")


def test_render_forward_of_all_vectors(spark):
    got = composite.render_forward(spark, FOLDER).select("image_id").collect()
    assert sorted(map(tuple, got)) == rows("select vec_id from embeddings")

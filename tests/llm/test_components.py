import random

import pytest

from lumenspark.llm import common, components


def brute(edges):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    return {x: top(x) for x in root}


@pytest.mark.parametrize("most", [0, 150, 1 << 18])
def test_rounds_and_one_task_agree(spark, monkeypatch, most):
    monkeypatch.setattr(components, "EDGES", most)
    some = random.Random(5)
    edges = [(some.randrange(-90, 90), some.randrange(-90, 90)) for _ in range(70)] + [(7, 7), (None, 3), (4, None), (1000, 1000), (-(2**63), 2**63 - 1)]
    edges += [(200 + k, 201 + k) for k in range(100)]
    edges += edges[:9] + [(b, a) for a, b in edges[:9]]
    rows = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in rows} == brute(edges) and len(rows) == len(brute(edges))
    assert not components.components(spark.createDataFrame([], "a bigint, b bigint")).collect()


def test_few_edges_leave_few_records_on_the_driver(spark):
    """Before, rounds of stars of any number of edges: hundreds of tasks over 211 partitions, whose records the driver keeps."""
    sc = spark.sparkContext
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)], "a bigint, b bigint").repartition(4).localCheckpoint()
    sc.setJobGroup("components", "few edges")
    try:
        found = components.components(edges).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert {(r.node, r.root) for r in found} == {(k, 0) for k in range(61)}
    tracker = sc.statusTracker()
    assert 0 < len(tracker.getJobIdsForGroup("components")) <= 6


@pytest.mark.parametrize("hot", [1, 3, common.HOT])
def test_spread_join_with_and_without_hot_keys(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    left = [(k, i) for i, k in enumerate([1, 1, 1, 1, 2, 2, 3, None, 5])]
    right = [(1, "a"), (2, "b"), (4, "d"), (None, "n")]
    got = common.spread_join(spark.createDataFrame(left, "k int, i int"), spark.createDataFrame(right, "k int, v string"), ["k"])
    assert got.columns == ["k", "i", "v"]
    assert sorted(map(tuple, got.collect())) == [(1, 0, "a"), (1, 1, "a"), (1, 2, "a"), (1, 3, "a"), (2, 4, "b"), (2, 5, "b")]

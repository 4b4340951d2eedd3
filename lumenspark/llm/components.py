"""Connected components of a graph given as edges: by alternating large and small stars, until one task can take the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspark.llm.common import cut, stored, tidy

#: Edges that one task takes, whatever the input: 4 MB of them, and some ten times as much while it joins them.
EDGES = 1 << 18


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links a-b: each value but the least of its group, and that least."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    tied = label != np.arange(len(nodes))
    return nodes[tied], nodes[label[tied]]


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the whole graph, which one task holds."""
    held = [(np.asarray(batch.column(0)), np.asarray(batch.column(1))) for batch in batches if batch.num_rows]
    if held:
        node, root = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        least = np.unique(root)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, least])), pa.array(np.concatenate([root, least]))], names=["node", "root"])
    held = None
    tidy()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs the neighbours of each node on the least of them and the node itself.

    The large star moves the larger neighbours; the small star moves the smaller ones and the node. Least
    neighbours come from partial aggregation and are joined back in a plain join, so that a node with very many
    neighbours burdens no single task.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("least"))
    joined = both.join(least, both.a == least.node)
    if large:
        made = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        made = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return made.where("a <> b").groupBy("a", "b").agg(F.lit(1).alias("one")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; the root is the least node that it can reach.

    ``edges`` has bigint columns ``a`` and ``b`` in any direction; loops, repeats and nulls are ignored. No edges
    give no rows. EDGES edges or fewer are joined in one task; more go through rounds of stars, each cut off in the shared
    folder, until as few are left or nothing changes. The driver sees counts and sums only; since it keeps a record of every
    task and plan, rounds of tiny tables would cost it more than anything else here.
    """
    now = edges.where("a is not null and b is not null and a <> b")
    now = stored(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    if now.count() > EDGES:
        now = cut(now.distinct())
        mark = _mark(now)
        while mark[0] > EDGES:
            now = cut(_star(_star(now, large=True), large=False))
            before, mark = mark, _mark(now)
            if before == mark:
                return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    return stored(now.coalesce(1).mapInArrow(_rooted, "node bigint, root bigint"), "roots")


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    one = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.sum(F.xxhash64("b", "a", F.lit(1)).cast("decimal(38,0)")).alias("g")).first()
    return one.n, one.h, one.g

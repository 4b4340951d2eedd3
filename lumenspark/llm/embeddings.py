"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Vectors are compared only within a label. Equal vectors of a label are one class, held by its least id and counted.
Classes are dealt to tiles, and each pair of a label's tiles is a cell that one task compares. There a vector of unit
length is q * s + r, with q in int8 and the length of r measured; the product of two differs from s * t * (q . p) by no
more than |r| + (1 + |r|) |r'|. Only pairs that this bound cannot rule out are computed again in double precision.
A cell returns link counts and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspark.llm.common import cut
from lumenspark.llm.components import components
from lumenspark.llm.simhash import forest

#: Vectors of a tile, about; and of a block, the side of the products made at a time.
TILE = 4096
BLOCK = 1024
#: Added to bounds for the rounding of the bounds themselves.
SLACK = 1e-9


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """q (int8), the scale, and an upper bound of the length of what is left, for rows of unit length."""
    scale = np.abs(vectors).max(axis=1) / 127
    q = np.rint(vectors / scale[:, None]).astype(np.int8)
    left = np.linalg.norm(vectors - q * scale[:, None], axis=1)
    return q, scale, left + SLACK


def close_pairs(x: np.ndarray, y: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) with cosine >= ``least`` in double precision; with y None, pairs i < j of x. Rows aren't zero."""

    def prepared(rows: np.ndarray) -> tuple:
        length = np.linalg.norm(rows, axis=1)
        q, scale, left = quantised(rows / length[:, None])
        # products of int8 are exact in float32 while their sum stays below 2**24
        return length, q.astype(np.float32 if rows.shape[1] * 127 * 127 < 1 << 24 else np.float64), scale, left

    def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], other[j[k : k + 65536]]) / (own[0][i[k : k + 65536]] * his[0][j[k : k + 65536]]) for k in range(0, len(i), 65536)])

    other = x if y is None else y
    own = prepared(x)
    his = own if y is None else prepared(y)
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(x), BLOCK):
        rows = slice(a, a + BLOCK)
        for b in range(a if y is None else 0, len(other), BLOCK):
            columns = slice(b, b + BLOCK)
            product = (own[1][rows] @ his[1][columns].T).astype(np.float64) * own[2][rows, None] * his[2][None, columns]
            bound = own[3][rows, None] + (1 + own[3][rows, None]) * his[3][None, columns] + SLACK
            i, j = np.nonzero(product + bound >= least)
            i, j = i + a, j + b
            if y is None:
                i, j = i[i < j], j[i < j]
            if len(i):
                sure = exact(i, j) >= least
                found_i.append(i[sure])
                found_j.append(j[sure])
    return np.concatenate(found_i), np.concatenate(found_j)


def _compare(least: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        side = np.asarray(cell["side"])
        ids, copies = np.asarray(cell["id"]), np.asarray(cell["copies"])
        vectors = np.asarray(cell["vector"].combine_chunks().flatten(), dtype=np.float64).reshape(len(side), -1)
        i, j = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if len(j):
            a, b = close_pairs(vectors[i], vectors[j], least) if len(i) else (i, i)
            a, b = i[a], j[b]
        else:
            a, b = close_pairs(vectors, None, least)
        n = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        linked = np.flatnonzero(n)
        from_, to = forest(ids[a], ids[b])
        return pa.Table.from_arrays(
            [pa.array(np.concatenate([ids[linked], from_])), pa.concat_arrays([pa.nulls(len(linked), pa.int64()), pa.array(to)]), pa.array(np.concatenate([n[linked].astype(np.int64), np.zeros(len(from_), np.int64)]))],
            schema=schema,
        )

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98) -> DataFrame:
    """One row per row of ``vectors``: the key, n_links, component_id and kept (key = component_id).

    Vectors link when their labels are equal and not null and their cosine in double precision is at least ``least``.
    A vector that is null, empty, all zero or has a null or non-finite component links with nothing, nor does one
    with a null key; its component is its key. Vectors of different lengths don't link. Repeated rows are equal vectors: each counts as a link of the others. ``key`` is a bigint that
    names one vector; rows of other vectors that repeat it share its component. Other columns are not looked at.
    """
    rows = vectors.select(F.col(key).alias("_key"), F.col(vector).alias("_vector"), F.col(label).alias("_label"))
    finite = F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = F.col("_key").isNotNull() & F.col("_label").isNotNull() & F.col("_vector").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("_vector", lambda x: x != 0)
    groups = rows.where(sound).groupBy("_label", "_vector").agg(F.min("_key").alias("id"), F.count(F.lit(1)).alias("copies"))
    groups = cut(groups.withColumn("size", F.size("_vector")))
    sides = groups.groupBy("_label", "size").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("tiles")).select(F.col("_label").alias("l"), F.col("size").alias("s"), "tiles")
    tiled = groups.join(sides, (groups._label == sides.l) & (groups["size"] == sides.s)).withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    dealt = tiled.select(F.col("_label").alias("label"), "size", "id", "copies", F.col("_vector").alias("vector"), "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("mate"))
    cells = dealt.select("label", "size", F.least("own", "mate").alias("row"), F.greatest("own", "mate").alias("col"), "id", "copies", "vector", (F.col("own") > F.col("mate")).cast("int").alias("side"))
    found = cut(cells.groupBy("label", "size", "row", "col").applyInArrow(_compare(least), "a bigint, b bigint, n bigint"))
    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    roots = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("id"), "root")
    known = groups.join(links, "id", "left").join(roots, "id", "left").select(F.col("_label").alias("l"), F.col("_vector").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "id").alias("root"))
    joined = rows.join(known, (rows._label == known.l) & (rows._vector == known.v) & rows._key.isNotNull(), "left")
    component = F.coalesce("root", "_key")
    return joined.select(F.col("_key").alias(key), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_key") == component, F.lit(False)).alias("kept"))

"""What the operators share: the shared folder, cuts of lineage and Arrow plumbing."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset, as in local tests, a temporary folder of this machine is set instead.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Bytes of an Arrow batch on its way to Python, where the session names no other.
BATCH = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keeps batches small enough for several Python workers beside an executor's heap, unless the session says how."""
    for name, value in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH), ("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)):
        if spark.conf.get(name, None) is None and spark.sparkContext.getConf().get(name) is None:
            spark.conf.set(name, str(value))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """Computes the frame once into the shared folder, so that lost executors cost no more than a read."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def stored(frame: DataFrame, name: str) -> DataFrame:
    """As ``cut``, but as a Parquet table: columns can be pruned and its size is known to the planner."""
    spark = frame.sparkSession
    path = fresh_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def unused(frame: DataFrame, name: str) -> str:
    """A name like the given one that the frame has no column of, whatever the case."""
    taken = {c.lower() for c in frame.columns}
    while f"_{name}" in taken:
        name = f"_{name}"
    return f"_{name}"


#: Names of a row's identity; no table is expected to have them, and one that does is refused.
ROW = ["__row_hash_0", "__row_hash_1"]


def identified(docs: DataFrame) -> DataFrame:
    """Adds 128 bits of hashes of the whole row, by which decisions on slim rows find their texts again."""
    columns = [docs[f"`{c}`"] for c in docs.columns]
    if {c.lower() for c in docs.columns} & set(ROW):
        raise ValueError(f"columns {ROW} are the row's identity")
    return docs.withColumns({ROW[0]: F.xxhash64(*columns), ROW[1]: F.xxhash64(F.lit(1), *columns)})


def once(rows: DataFrame) -> DataFrame:
    """One of each set of identical rows; a join on the identity before or after needs no other exchange."""
    copy = unused(rows, "copy")
    return rows.withColumn(copy, F.row_number().over(Window.partitionBy(*ROW).orderBy(F.lit(1)))).where(F.col(copy) == 1).drop(copy)


#: Rows of a key beyond which it may be joined apart, and how many keys that can be at most.
HOT, HOT_KEYS = 4096, 1024


def spread_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The inner join with a ``right`` that has one row for each key, whatever keys most rows of ``left`` have.

    Keys with over HOT rows and over one row in HOT_KEYS, so no more than HOT_KEYS of them, meet their row by broadcast.
    Without such keys it is a plain join. ``left`` is read up to four times: it should be a written or checkpointed frame. Null
    keys meet nothing.
    """
    rows = left.count()
    if rows <= HOT:
        return left.join(right, on)
    keys = stored(left.groupBy(*on).count().where(F.col("count") > max(HOT, rows // HOT_KEYS)).select(*on), "hot")
    if keys.isEmpty():
        return left.join(right, on)
    hot = stored(right.join(F.broadcast(keys), on, "left_semi"), "hot-rows")
    apart = left.join(F.broadcast(hot), on)
    return apart.unionByName(left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right, on))


def map_rows(frame: DataFrame, schema: str | T.StructType, fn: Callable[[dict[str, list]], dict[str, list] | None]) -> DataFrame:
    """Applies ``fn`` to the columns of each Arrow batch, as lists; the lists it returns are the new columns."""
    bounded_batches(frame.sparkSession)
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                made = fn({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                if made is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(made[n], arrow.field(n).type) for n in names], schema=arrow)
        tidy()

    return frame.mapInArrow(run, schema)


def tidy() -> None:
    """Called at the end of a task's Python part: gives what its allocators hold back to the system.

    Spark uses a Python worker again for the next task, so what one stage leaves would be added to the next one's.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        ctypes.CDLL(None).malloc_trim(0)


def sliced(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into slices of about ``most`` bytes, a row at least, so that Python holds little at a time."""
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, int(rows * most / max(batch.nbytes, most)))
    for at in range(0, rows, step):
        yield batch.slice(at, step)

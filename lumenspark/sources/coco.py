"""Annotated image folders: one JSON file of images, annotations and categories, and the encoded files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """images array<struct<id:bigint,file_name:string,height:int,width:int>>,
annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>,area:double,iscrowd:int>>,
categories array<struct<id:bigint,name:string>>"""


@dataclass(frozen=True)
class Annotated:
    """``images`` (image_id, file_name, height, width, ordinal), ``gt`` as the detection operators take it, ``categories``
    and ``dropped``, the number of boxes without area."""

    images: DataFrame
    gt: DataFrame
    categories: DataFrame
    dropped: DataFrame


def read_annotations(spark: SparkSession, path: str, offset: int = 0, limit: int | None = None, ordered: list[int] | None = None) -> Annotated:
    """Images in ascending order of id, from the offset on, or just those listed, in that order.

    The file is parsed once into rows; images that repeat an id are an error. Boxes become corners; those whose width,
    height or area isn't positive go and are counted.
    """
    whole = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    every = whole.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name", "i.height", "i.width")
    twice = every.groupBy("image_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"image {twice[0].image_id} is listed twice")
    if ordered is not None:
        if offset or limit is not None:
            raise ValueError("give a list or an offset and limit, not both")
        wanted = spark.createDataFrame([(k, i) for i, k in enumerate(ordered)], "image_id bigint, ordinal int")
        images = every.join(F.broadcast(wanted), "image_id")
        if images.count() != len(ordered):
            raise ValueError("a listed image isn't there, or is listed twice")
    else:
        from lumenspark.operators.selection import numbered_partitions

        images = numbered_partitions(every, "image_id", 1 << 30).drop("shard").where(F.col("ordinal") >= offset)
        images = images.where(F.col("ordinal") < offset + limit) if limit is not None else images
        images = images.withColumn("ordinal", (F.col("ordinal") - offset).cast("int"))
    boxes = whole.select(F.explode("annotations").alias("a")).select("a.*").join(images.select("image_id"), "image_id")
    wide, high = F.col("bbox")[2], F.col("bbox")[3]
    sound = (wide > 0) & (high > 0) & (F.coalesce(F.col("area"), wide * high) > 0)
    x, y = F.col("bbox")[0], F.col("bbox")[1]
    gt = boxes.where(sound).select("image_id", "category_id", F.col("id").cast("int").alias("gt_idx"), x.alias("x1"), y.alias("y1"), (x + wide).alias("x2"), (y + high).alias("y2"), F.coalesce("area", wide * high).alias("area"), F.coalesce("iscrowd", F.lit(0)).alias("iscrowd"))
    categories = whole.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), "c.name").distinct()
    return Annotated(images, gt, categories, boxes.select(F.count_if(~sound).alias("dropped")))


def image_files(spark: SparkSession, folder: str, images: DataFrame) -> DataFrame:
    """(image_id, path, length, sha256, content) of the listed files; content is read only where it is used."""
    files = spark.read.format("binaryFile").load(folder).withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    return files.join(images.select("image_id", "file_name"), "file_name").select("image_id", "path", "length", F.sha2("content", 256).alias("sha256"), "content")


def decoded(files: DataFrame) -> DataFrame:
    """Frames in 0 to 1 from encoded files. Portable pixmaps (P5, P6) are read here; others need Pillow."""
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    from lumenspark.operators.frames import SCHEMA as FRAMES

    def one(data: bytes) -> np.ndarray:
        if data[:2] in (b"P5", b"P6"):
            fields = data.split(maxsplit=4)[:4]
            width, height, most = map(int, fields[1:4])
            channels = 3 if data[:2] == b"P6" else 1
            return np.frombuffer(data[-width * height * channels :], np.uint8).reshape(height, width, channels) / most
        import io

        from PIL import Image

        return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"), np.float32) / 255

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                image = one(bytes(r.content))
                yield pd.DataFrame({"image_id": [r.image_id], "height": [image.shape[0]], "width": [image.shape[1]], "channels": [image.shape[2]], "data": [image.astype(float).ravel()]})

    return files.select("image_id", "content").mapInPandas(run, FRAMES)

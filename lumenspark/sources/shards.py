"""Prediction shards: gzip files of canonical JSON lines with receipts, resumable and checked on reading.

A shard is a header line and one line for each of its images, in order. The files are small and many; they are written
by the driver's own file system calls into a folder that the caller names, and read by Spark from any store.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import os
from collections.abc import Iterator, Sequence
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.functions.identity import is_sealed, json_line, sealed, selection_identity

RECEIPT = ".receipt.json"


def header(study: dict[str, Any], image_ids: Sequence[int]) -> dict[str, Any]:
    return sealed({"record_type": "prediction_shard_header", "study": study, "selection": selection_identity(image_ids)}, "header_sha256")


def row(image_id: int, prediction: dict[str, Any]) -> dict[str, Any]:
    return {"record_type": "prediction", "image_id": image_id, "prediction": prediction}


def packed(records: Iterator[dict[str, Any]]) -> bytes:
    """Gzip without a time or name, so that equal records are equal bytes."""
    out = io.BytesIO()
    with gzip.GzipFile(filename="", mode="wb", compresslevel=9, fileobj=out, mtime=0) as f:
        for record in records:
            f.write(json_line(record))
    return out.getvalue()


def write(path: str | os.PathLike, head: dict[str, Any], predictions: dict[int, dict[str, Any]]) -> dict[str, Any]:
    """Writes a shard, then its receipt, never over another file; returns the receipt.

    A shard that is there with its receipt is checked and left; one without is an error, as is another's content.
    """
    path = Path(path)
    ids = head["selection"]["ordered"]
    if sorted(predictions) != sorted(ids):
        raise ValueError("a shard has one prediction for each of its images")
    data = packed(iter([head, *[row(i, predictions[i]) for i in ids]]))
    receipt = sealed({"record_type": "prediction_shard_receipt", "file": path.name, "sha256": hashlib.sha256(data).hexdigest(), "bytes": len(data), "rows": len(ids), "header_sha256": head["header_sha256"]}, "receipt_sha256")
    there = existing(path)
    if there is not None:
        if there != receipt:
            raise FileExistsError(f"{path} holds another shard")
        return there
    for target, content in ((path, data), (Path(f"{path}{RECEIPT}"), json_line(receipt))):  # the receipt is last
        draft = target.with_name(f".{target.name}.{os.getpid()}")
        draft.write_bytes(content)
        os.link(draft, target)
        draft.unlink()
    return receipt


def existing(path: str | os.PathLike) -> dict[str, Any] | None:
    """The receipt of a whole shard, None if there is nothing; half of one is an error."""
    path, receipt = Path(path), Path(f"{path}{RECEIPT}")
    if not path.exists() and not receipt.exists():
        return None
    if not path.exists() or not receipt.exists():
        raise ValueError(f"{path} is half published")
    record = json.loads(receipt.read_bytes())
    data = path.read_bytes()
    if not is_sealed(record, "receipt_sha256") or record["bytes"] != len(data) or record["sha256"] != hashlib.sha256(data).hexdigest():
        raise ValueError(f"{path} is not what its receipt says")
    return record


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(path, study, image_id, ordinal, prediction as JSON) of all shards of a folder, each checked where it is read:
    against its receipt, line by line against canonical JSON, and in order against its header's images."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    receipts = files.where(F.col("path").endswith(RECEIPT)).select(F.regexp_replace("path", RECEIPT.replace(".", r"\.") + "$", "").alias("path"), F.col("content").alias("receipt"))
    pairs = files.where(~F.col("path").endswith(RECEIPT)).join(receipts, "path", "full_outer")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                yield _checked(r.path, r.content, r.receipt)

    return pairs.select("path", "content", "receipt").mapInPandas(run, "path string, study string, image_id bigint, ordinal int, prediction string")


def _checked(path: str, content: bytes | None, receipt: bytes | None) -> pd.DataFrame:
    if content is None or receipt is None:
        raise ValueError(f"{path} is half published")
    record, data = json.loads(receipt), bytes(content)
    if not is_sealed(record, "receipt_sha256") or record["sha256"] != hashlib.sha256(data).hexdigest() or record["bytes"] != len(data):
        raise ValueError(f"{path} is not what its receipt says")
    if data[4:8] != b"\0\0\0\0":
        raise ValueError(f"{path} holds a time of writing")
    lines = gzip.decompress(data).splitlines(keepends=True)
    records = [json.loads(x) for x in lines]
    if any(json_line(r) != x for r, x in zip(records, lines, strict=True)):
        raise ValueError(f"{path} has lines that aren't canonical")
    head, rows = records[0], records[1:]
    if not is_sealed(head, "header_sha256") or head["header_sha256"] != record["header_sha256"] or [r["image_id"] for r in rows] != head["selection"]["ordered"]:
        raise ValueError(f"{path} doesn't hold its header's images in order")
    study = json_line(head["study"]).decode().strip()
    return pd.DataFrame({"path": path, "study": study, "image_id": [r["image_id"] for r in rows], "ordinal": range(len(rows)), "prediction": [json_line(r["prediction"]).decode().strip() for r in rows]})


def detections(shards: DataFrame) -> DataFrame:
    """The box table of the shards' predictions {boxes, labels, scores}."""
    kind = "struct<boxes:array<array<double>>,labels:array<bigint>,scores:array<double>>"
    parsed = shards.select("study", "image_id", F.from_json("prediction", kind, {"mode": "FAILFAST"}).alias("p"))
    each = parsed.select("study", "image_id", F.posexplode(F.arrays_zip("p.boxes", "p.labels", "p.scores")).alias("det_idx", "d"))
    return each.select("study", "image_id", F.col("d.labels").alias("category_id"), "det_idx", *[F.col("d.boxes")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))], F.col("d.scores").alias("score"))

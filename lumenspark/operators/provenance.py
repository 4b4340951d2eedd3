"""Identities of artifacts, models, executions, runtimes and results: records that carry their own digest.

Artifacts are rows wherever there may be many of them; a record is a dictionary of one model, run or result.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import os
import platform
import re
import unicodedata
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.functions.identity import canonical_array, canonical_bytes, canonical_long, canonical_map, canonical_text, digest, is_sealed, sealed

DIGEST = re.compile("[0-9a-f]{64}")
#: The fields of the records.
EXECUTION = ("model_sha256", "implementation_id", "requested_device", "actual_device", "device_attestation", "inference_execution")


def artifacts(rows: DataFrame, name: str, content: str) -> DataFrame:
    """(name, bytes, sha256) of each row; a null content is empty. Names are taken as text."""
    data = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    return rows.select(F.col(name).cast("string").alias("name"), F.octet_length(data).cast("bigint").alias("bytes"), F.sha2(data, 256).alias("sha256"))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, bytes, sha256) of all files under a folder, hashed where they are read; names are relative to it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    whole = F.regexp_replace(F.col("path"), "^[a-z0-9]+:/*", "/")
    name = whole.substr(F.lit(len(folder.rstrip("/")) + 2), F.length(whole))
    return artifacts(found.select(name.alias("name"), "content"), "name", "content")


def drift(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(problem, name): 'missing', 'unexpected' or 'changed'; no rows means that both hold the same artifacts."""
    mark = lambda rows, c: rows.select("name", F.struct("bytes", "sha256").alias(c))
    both = mark(expected, "_want").join(mark(found, "_have"), "name", "full_outer")
    problem = F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "unexpected").when(F.col("_have") != F.col("_want"), "changed")
    return both.select(problem.alias("problem"), "name").where("problem is not null")


def artifact_canonical(name: Column, size: Column, sha256: Column) -> Column:
    return canonical_map({"name": canonical_text(name), "bytes": canonical_long(size), "sha256": canonical_text(sha256)})


def models(rows: DataFrame, by: str, backend: str) -> DataFrame:
    """(model_id, artifacts, model_sha256): one model for each value of ``by``, of its few artifacts in order of their names.

    The digest is that of ``model_record`` without revision and implementation.
    """
    one = F.struct("name", artifact_canonical(F.col("name"), F.col("bytes"), F.col("sha256")).alias("canonical"))
    made = rows.groupBy(F.col(by).alias("model_id")).agg(F.sort_array(F.collect_list(one)).alias("all"))
    none = F.lit("n;")
    record = {"artifacts": canonical_array(F.transform("all", lambda a: a.canonical)), "backend": canonical_text(F.lit(backend)), "identity_verified": F.lit("b1;"), "implementation": none, "model_id": canonical_text(F.col("model_id")), "revision": none}
    return made.select("model_id", F.size("all").alias("artifacts"), digest(canonical_map(record)).alias("model_sha256"))


def described(name: str, data: bytes) -> dict[str, Any]:
    return {"name": _text(name, "name"), "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}


def described_file(path: str | os.PathLike, name: str | None = None) -> dict[str, Any]:
    """As ``described``, read in pieces; the record has no path."""
    with Path(path).expanduser().open("rb") as f:
        found = hashlib.file_digest(f, "sha256").hexdigest()
        return {"name": _text(name if name is not None else Path(path).name, "name"), "bytes": f.tell(), "sha256": found}


def same_artifact(actual: Mapping[str, Any], expected: Mapping[str, Any]) -> dict[str, Any]:
    """The actual artifact, if its size and digest are the expected ones; else an error that names what differs."""
    wrong = [c for c in ("bytes", "sha256") if actual[c] != expected[c]]
    if wrong:
        raise RuntimeError(f"{actual['name']}: {', '.join(wrong)} differ")
    return dict(actual)


def model_record(backend: str, model_id: str, artifacts: Sequence[Mapping[str, Any]], revision: str | None = None, implementation: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """A model by the content of its artifacts, one at least, under different names."""
    own = [{"name": _text(a["name"], "name"), "bytes": a["bytes"], "sha256": a["sha256"]} for a in artifacts]
    if not own or len({a["name"] for a in own}) != len(own):
        raise ValueError("a model has artifacts of different names, one at least")
    if any(type(a["bytes"]) is not int or a["bytes"] < 0 or not DIGEST.fullmatch(str(a["sha256"])) for a in own):
        raise ValueError("an artifact has a size and a digest")
    about = {"backend": _text(backend, "backend"), "model_id": _text(model_id, "model_id"), "revision": None if revision is None else _text(revision, "revision")}
    ordered = sorted(own, key=lambda a: a["name"].encode())
    return sealed({**about, "artifacts": ordered, "implementation": None if implementation is None else dict(implementation), "identity_verified": True}, "model_sha256")


def is_model(record: Mapping[str, Any]) -> bool:
    """Whether the record is what its own fields make."""
    fields = ("backend", "model_id", "artifacts", "revision", "implementation")
    try:
        return model_record(*[record[c] for c in fields]) == dict(record)
    except (KeyError, TypeError, ValueError):
        return False


def execution_record(model: Mapping[str, Any], implementation_id: str, requested_device: str, actual_device: str, device_attestation: Mapping[str, Any], inference_execution: Mapping[str, Any]) -> dict[str, Any]:
    """What ran a model and where. Devices must agree, a device without a number with any number of its kind."""
    if not is_model(model):
        raise ValueError("not a model record")
    values = (model["model_sha256"], implementation_id, requested_device, actual_device, dict(device_attestation), dict(inference_execution))
    record = sealed({"record_type": "detector_execution_identity", "schema_version": 3, **dict(zip(EXECUTION, values, strict=True))}, "detector_execution_sha256")
    if not is_execution(record, model):
        raise ValueError("not an attested execution")
    return record


def is_execution(record: Mapping[str, Any], model: Mapping[str, Any] | None = None) -> bool:
    """Whether an execution is sealed, attested, on the device that was asked for, and of the model, if one is given."""
    wanted = {"record_type", "schema_version", "detector_execution_sha256", *EXECUTION}
    if set(record) != wanted or not is_sealed(record, "detector_execution_sha256") or (record["record_type"], record["schema_version"]) != ("detector_execution_identity", 3):
        return False
    asked, got = str(record["requested_device"]), str(record["actual_device"])
    agree = got == asked or (":" not in asked and got.partition(":")[0] == asked)
    device, inference = record["device_attestation"], record["inference_execution"]
    attested = device.get("matches") is True and inference.get("attested") is True and bool(device.get("method")) and bool(inference.get("method"))
    return bool(asked and record["implementation_id"]) and agree and attested and bool(DIGEST.fullmatch(str(record["model_sha256"]))) and (model is None or model["model_sha256"] == record["model_sha256"])


def array_sha256(values: Any, tag: bytes = b"array-sha256-v1") -> str:
    """Digest of a numeric array: its type, its shape and its values as little-endian doubles, complex or not."""
    kind = "<c16" if np.iscomplexobj(values) else "<f8"
    own = np.ascontiguousarray(values, dtype=kind)
    head = b"\0".join([tag, kind.encode(), ",".join(map(str, np.shape(values))).encode(), b""])
    return hashlib.sha256(head + own.tobytes()).hexdigest()


def runtime_record() -> dict[str, Any]:
    """The interpreter, the machine's kind and all installed distributions."""
    found = {re.sub("[-_.]+", "-", d.metadata["Name"]).lower(): d.version for d in importlib.metadata.distributions() if d.metadata["Name"]}
    return sealed({"python": platform.python_version(), "system": platform.system(), "machine": platform.machine(), "cores": os.cpu_count(), "distributions": found}, "runtime_sha256")


def result_record(about: Mapping[str, Any], metrics: Mapping[str, Any], runtime: Mapping[str, Any]) -> dict[str, Any]:
    """A result bound to the runtime that made it."""
    if not is_sealed(runtime, "runtime_sha256"):
        raise ValueError("not a runtime record")
    return sealed({"record_type": "result", "about": dict(about), "metrics": dict(metrics), "runtime": dict(runtime)}, "result_sha256")


def is_result(record: Mapping[str, Any]) -> bool:
    return set(record) == {"record_type", "about", "metrics", "runtime", "result_sha256"} and is_sealed(record, "result_sha256") and is_sealed(record["runtime"], "runtime_sha256")


def _text(value: str, field: str) -> str:
    made = unicodedata.normalize("NFC", value)
    if not made:
        raise ValueError(f"{field} is empty")
    return made


def key_text(name: str) -> str:
    """A key as it stands in a canonical map."""
    return canonical_bytes(name).decode()

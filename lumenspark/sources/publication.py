"""Published tables: one row order, one number format, content-addressed names, an index written last."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from lumenspark.functions.identity import is_sealed, json_line, sealed

#: Rows of a published table at most: it is a report, collected on the driver.
ROWS = 1 << 20


def csv_bytes(rows: DataFrame, order: list[str]) -> bytes:
    """UTF-8, line feeds, columns as they are, rows by ``order``, doubles to 17 digits, nulls empty, booleans in lower case."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(rows.columns)
    taken = rows.orderBy(*order).limit(ROWS + 1).collect()
    if len(taken) > ROWS:
        raise ValueError("a published table is a report, not a data set")
    for r in taken:
        writer.writerow([_cell(v) for v in r])
    return out.getvalue().encode()


def _cell(value: Any) -> Any:
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    return format(value, ".17g") if isinstance(value, float) else value


def publish(folder: str | os.PathLike, tables: dict[str, bytes], about: dict[str, Any]) -> dict[str, Any]:
    """Writes each table under its digest, then the index that names them; the same again changes nothing.

    An index that is there with other content is an error: nothing that was published is replaced.
    """
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    names = {}
    for name, data in sorted(tables.items()):
        stem, _, end = name.rpartition(".")
        names[name] = {"file": f"{stem}-{hashlib.sha256(data).hexdigest()}.{end}", "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}
        _once(folder / names[name]["file"], data)
    index = sealed({"about": about, "tables": names}, "index_sha256")
    _once(folder / "index.json", json_line(index))
    return index


def _once(path: Path, data: bytes) -> None:
    if path.exists():
        if path.read_bytes() != data:
            raise FileExistsError(f"{path} was published with other content")
        return
    draft = path.with_name(f".{path.name}.{os.getpid()}")
    draft.write_bytes(data)
    os.link(draft, path)
    draft.unlink()


def published(folder: str | os.PathLike) -> dict[str, bytes]:
    """The tables of a publication, each checked against the index, which is checked against itself."""
    folder = Path(folder)
    index = json.loads((folder / "index.json").read_bytes())
    if not is_sealed(index, "index_sha256"):
        raise ValueError("the index is not what it was")
    out = {}
    for name, about in index["tables"].items():
        data = (folder / about["file"]).read_bytes()
        if hashlib.sha256(data).hexdigest() != about["sha256"]:
            raise ValueError(f"{name} is not what it was")
        out[name] = data
    return out

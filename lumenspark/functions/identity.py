"""Canonical bytes and digests of nested records."""

from __future__ import annotations

import hashlib
import json
import math
import struct
import unicodedata
from collections.abc import Mapping, Sequence
from enum import Enum
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_bytes(value: Any) -> bytes:
    """The value in a grammar that tells types apart and delimits itself.

    null ``n;`` booleans ``b0;`` ``b1;`` integers ``i<decimal>;`` doubles ``f<16 hex digits>;`` text ``s<bytes>:<UTF-8>``
    arrays ``a<count>[...]`` maps ``m<pairs>{key value ...}`` with NFC keys in order of their UTF-8. Numbers must be
    finite; what has no order, or no such type, is an error.
    """
    match value:
        case Enum():
            return canonical_bytes(value.value)
        case None:
            return b"n;"
        case bool() | np.bool_():
            return b"b1;" if value else b"b0;"
        case int() | np.integer():
            return b"i%d;" % int(value)
        case float() | np.floating():
            if not math.isfinite(value):
                raise ValueError("numbers must be finite")
            return b"f" + struct.pack(">d", float(value)).hex().encode() + b";"
        case str():
            data = unicodedata.normalize("NFC", value).encode()
            return b"s%d:" % len(data) + data
        case Mapping():
            pairs = {unicodedata.normalize("NFC", k): v for k, v in value.items() if isinstance(k, str)}
            if len(pairs) != len(value):
                raise ValueError("keys must be text, and different once normalised")
            body = b"".join(canonical_bytes(k) + canonical_bytes(pairs[k]) for k in sorted(pairs, key=str.encode))
            return b"m%d{" % len(pairs) + body + b"}"
        case np.ndarray():
            return canonical_bytes(value.tolist())
        case bytes() | bytearray():
            raise TypeError("bytes have no canonical form")
        case Sequence():
            return b"a%d[" % len(value) + b"".join(map(canonical_bytes, value)) + b"]"
    raise TypeError(f"{type(value).__name__} has no canonical form")


def canonical_sha256(value: Any) -> str:
    return hashlib.sha256(canonical_bytes(value)).hexdigest()


def sealed(payload: Mapping[str, Any], name: str) -> dict[str, Any]:
    """The record with its own digest beside it."""
    return {**payload, name: canonical_sha256(payload)}


def is_sealed(record: Mapping[str, Any], name: str) -> bool:
    return record.get(name) == canonical_sha256({k: v for k, v in record.items() if k != name})


def json_line(record: Any) -> bytes:
    """One line of canonical JSON: sorted keys, no spaces, no escapes of what needs none."""
    return json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode() + b"\n"


def number_token(value: float) -> str:
    """A number as part of a name: 0.5 is 0p5."""
    return format(float(value), ".17g").translate(str.maketrans({"-": "m", "+": "p", ".": "p"}))


def selection_identity(ordered: Sequence[int]) -> dict[str, Any]:
    """Count, ends and digest of an ordered axis of different integers."""
    if not ordered or len(set(ordered)) != len(ordered):
        raise ValueError("a selection has different members, one at least")
    return sealed({"count": len(ordered), "first": ordered[0], "last": ordered[-1], "ordered": list(ordered)}, "selection_sha256")


# the same grammar as column expressions, for digests of table rows


def canonical_long(value: Column) -> Column:
    return F.when(value.isNull(), "n;").otherwise(F.concat(F.lit("i"), value.cast("string"), F.lit(";")))


def canonical_text(value: Column) -> Column:
    """Of text that is already NFC."""
    return F.when(value.isNull(), "n;").otherwise(F.concat(F.lit("s"), F.octet_length(value).cast("string"), F.lit(":"), value))


def canonical_array(items: Column) -> Column:
    """Of an array of canonical items."""
    return F.concat(F.lit("a"), F.size(items).cast("string"), F.lit("["), F.array_join(items, ""), F.lit("]"))


def canonical_map(pairs: dict[str, Column]) -> Column:
    """Of canonical values under fixed keys."""
    body = [x for k in sorted(pairs, key=str.encode) for x in (F.lit(canonical_bytes(k).decode()), pairs[k])]
    return F.concat(F.lit(f"m{len(pairs)}{{"), *body, F.lit("}"))


def digest(canonical: Column) -> Column:
    return F.sha2(canonical, 256)

"""Line deduplication by sharded cuckoo filters over exact reference counts.

The index of a corpus is two tables. ``counts`` holds every line key with the number of documents that refer to it,
by shard of the key. ``filters`` holds one cuckoo filter for each shard over the keys that enough documents share,
and beside it the few other keys of the shard which that filter wrongly admits, found by auditing it against the
exact counts. A filter less its exceptions therefore answers exactly for every line of an indexed document, so a
document is rewritten where it is read: neither texts nor lines are shuffled.

Documents can be inserted and deleted. Either changes counts by what they hold; keys that pass the threshold enter or
leave their shard's filter, so an insertion followed by a deletion restores every answer.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.llm.common import bounded_batches, fresh_path, map_rows, sliced, stored, tidy, unused

#: Fixed value: white space that a key loses at both ends.
BLANK = b" \t\n\x0b\x0c\r"
#: Keys of a shard, about; entries of a task's counter before it is passed on; bytes that may be broadcast.
SHARD_KEYS = 1 << 17
COUNTER = 1 << 18
BROADCAST = 64 << 20


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128 bits of the stripped, A-Z lower-cased line; None if it has under ``min_chars`` code points."""
    key = line.strip(BLANK).lower()
    if len(key) < min_chars or (min_chars > 1 and len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


class CuckooFilter:
    """A cuckoo filter of 16-bit marks, four to a bucket, over keys given as 64-bit halves of their digests."""

    def __init__(self, buckets: int, table: bytes | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, 4), np.uint16) if table is None else np.frombuffer(table, np.uint16).reshape(-1, 4).copy()

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, keys) / 3.2 + 1)))))

    def _places(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low = np.asarray(low).view(np.uint64)
        mark = (low & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (low >> np.uint64(16)).astype(np.int64) & (self.buckets - 1)
        return mark, first, first ^ self._step(mark.astype(np.int64))

    def _step(self, mark):
        """Between a mark's two buckets; never 0 where there are two."""
        return ((mark * 0x5BD1E995) >> 7 | 1) & (self.buckets - 1)

    def holds(self, low: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(low)
        return ((self.table[a] == mark[:, None]) | (self.table[b] == mark[:, None])).any(axis=1)

    def insert(self, low: np.ndarray) -> bool:
        """False if it is too full; it must then be made anew from the exact keys."""
        for mark, a, b in zip(*(x.tolist() for x in self._places(low)), strict=True):
            if not self._put(mark, a, b):
                return False
        return True

    def _put(self, mark: int, a: int, b: int) -> bool:
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        at = a
        for kick in range(500):
            slot = (kick * 7 + mark) & 3
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            at ^= int(self._step(mark))
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        return False

    def delete(self, low: np.ndarray) -> None:
        """Of keys that were inserted."""
        for mark, a, b in zip(*(x.tolist() for x in self._places(low)), strict=True):
            for at in (a, b):
                own = np.flatnonzero(self.table[at] == mark)
                if len(own):
                    self.table[at, own[0]] = 0
                    break


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def reference_counts(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """(high, low, refs): the number of rows of ``docs`` that hold each key; summed in the task before it is dealt."""
    bounded_batches(docs.sparkSession)
    out = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("refs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            high, low = _halves(list(seen))
            made = pa.RecordBatch.from_arrays([pa.array(high), pa.array(low), pa.array(list(seen.values()), pa.int64())], schema=out)
            seen.clear()
            return made

        for batch in batches:
            for part in sliced(batch):
                for data in part.column(0).to_pylist():
                    found = {line_key(x, min_chars) for x in (data or b"").split(b"\n")}
                    found.discard(None)
                    seen.update(found)
                    if len(seen) > COUNTER:
                        yield flush()
        if seen:
            yield flush()
        tidy()

    each = docs.select(F.col(text).cast("binary").alias("_data")).mapInArrow(run, "high bigint, low bigint, refs bigint")
    return each.groupBy("high", "low").agg(F.sum("refs").alias("refs"))


def without_copies(docs: DataFrame, text: str, key: str) -> DataFrame:
    """The rows of ``docs`` with each text once, at its least key; rows that repeat that key all stay.

    Only the digests of texts that occur twice are joined back, and a copy's rows are told apart by key before.
    """
    first, second, least = (unused(docs, x) for x in ("first", "second", "least"))
    marked = docs.withColumns(dict(zip((first, second), _digests(F.col(text).cast("binary")), strict=True)))
    copied = stored(marked.groupBy(first, second).agg(F.min(key).alias(least), F.count(F.lit(1)).alias("n")).where("n > 1").select(first, second, least), "copied")
    joined = marked.join(copied, [first, second], "left")
    return joined.where(F.col(least).isNull() | F.col(key).eqNullSafe(F.col(least))).select(*[f"`{c}`" for c in docs.columns])


def _digests(data: Column) -> tuple[Column, Column]:
    content = F.coalesce(data, F.lit(b""))
    return F.xxhash64(content), F.xxhash64(F.lit(1), content)


_FILTERS = "shard int, buckets bigint, cells binary, exceptions binary"
_HITS = "_d0 bigint, _d1 bigint, at int"


def _refreshed(min_docs: int):
    """Brings one shard's filter in line with its counts; was and refs are counts before and after."""
    schema = pa.schema([("shard", pa.int32()), ("buckets", pa.int64()), ("cells", pa.binary()), ("exceptions", pa.binary())])

    def run(counts: pa.Table, filters: pa.Table) -> pa.Table:
        if not counts.num_rows:
            return schema.empty_table()
        high, low, refs, before = (counts[c].to_numpy() for c in ("high", "low", "refs", "was"))
        shared, was = refs >= min_docs, before >= min_docs
        table = None
        if filters.num_rows:
            table = CuckooFilter(filters["buckets"][0].as_py(), filters["cells"][0].as_py())
            table.delete(low[was & ~shared])
            if not table.insert(low[shared & ~was]):
                table = None
        if table is None:
            table = CuckooFilter.sized(int(shared.sum()))
            while not table.insert(low[shared]):
                table = CuckooFilter(table.buckets * 2)
        wrong = table.holds(low) & ~shared
        exceptions = np.stack([high[wrong], low[wrong]], axis=1).astype("<i8").tobytes()
        made = [[counts["shard"][0].as_py()], [table.buckets], [table.table.tobytes()], [exceptions]]
        tidy()
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(made, schema, strict=True)], schema=schema)

    return run


def _probed(probes: pa.Table, filters: pa.Table) -> pa.Table:
    """The places of one shard's probes that its filter drops."""
    out = pa.schema([("_d0", pa.int64()), ("_d1", pa.int64()), ("at", pa.int32())])
    if not (probes.num_rows and filters.num_rows):
        return out.empty_table()
    high, low = probes["high"].to_numpy(), probes["low"].to_numpy()
    own = _Exact.of(filters["buckets"][0].as_py(), filters["cells"][0].as_py(), filters["exceptions"][0].as_py())
    return probes.select(["_d0", "_d1", "at"]).filter(pa.array(own.holds(high, low)))


@dataclass(frozen=True)
class _Exact:
    """A filter and its exceptions: right for every key of its shard."""

    table: CuckooFilter
    exceptions: frozenset[bytes]

    @classmethod
    def of(cls, buckets: int, cells: bytes, wrong: bytes) -> _Exact:
        return cls(CuckooFilter(buckets, cells), frozenset(wrong[i : i + 16] for i in range(0, len(wrong), 16)))

    def holds(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        found = self.table.holds(low)
        if self.exceptions and found.any():
            at = np.flatnonzero(found)
            digests = np.stack([high[at], low[at]], axis=1).astype("<i8").tobytes()
            found[at] = [digests[i : i + 16] not in self.exceptions for i in range(0, len(digests), 16)]
        return found


def _places(texts: list[bytes | None], min_chars: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lines of each text, and of each key the text, the line, and the halves of its digest."""
    split = [(x or b"").split(b"\n") for x in texts]
    keys, owner, place = [], [], []
    for i, lines in enumerate(split):
        for j, line in enumerate(lines):
            if key := line_key(line, min_chars):
                keys.append(key)
                owner.append(i)
                place.append(j)
    return split, np.array(owner, np.int64), np.array(place, np.int64), *_halves(keys)


def _rest(split: list[list[bytes]], gone: list[set[int]], names: tuple[str, str, str]) -> dict[str, list]:
    kept = [b"\n".join(y for j, y in enumerate(x) if j not in g) if g else b"\n".join(x) for x, g in zip(split, gone, strict=True)]
    return dict(zip(names, ([x.decode() for x in kept], [len(x) for x in split], [len(g) for g in gone]), strict=True))


@dataclass(frozen=True)
class LineIndex:
    """One generation of the index: tables in the shared folder. ``insert`` and ``delete`` return the next one."""

    spark: SparkSession
    path: str | None
    shards: int
    min_docs: int = 10
    min_chars: int = 1

    @classmethod
    def empty(cls, spark: SparkSession, min_docs: int = 10, min_chars: int = 1) -> LineIndex:
        return cls(spark, None, 0, min_docs, min_chars)

    def counts(self) -> DataFrame:
        """(shard, high, low, refs) of every key with a reference."""
        return self.spark.read.schema("high bigint, low bigint, refs bigint, was bigint, shard int").parquet(f"{self.path}/counts").where("refs > 0").drop("was")

    def filters(self) -> DataFrame:
        return self.spark.read.schema(_FILTERS).parquet(f"{self.path}/filters")

    def insert(self, docs: DataFrame, text: str = "text") -> LineIndex:
        return self._changed(reference_counts(docs, text, self.min_chars))

    def delete(self, docs: DataFrame, text: str = "text") -> LineIndex:
        """Of rows that were inserted. A key that would fall below no references is an error."""
        return self._changed(reference_counts(docs, text, self.min_chars).withColumn("refs", -F.col("refs")))

    def _changed(self, change: DataFrame) -> LineIndex:
        path = fresh_path(self.spark, "lines")
        change = change.withColumn("was", F.lit(0).cast("bigint"))
        if self.path:
            change = change.unionByName(self.counts().select("high", "low", "refs", F.col("refs").alias("was")))
            change = change.groupBy("high", "low").agg(F.sum("refs").alias("refs"), F.sum("was").alias("was"))
        change = change.withColumn("refs", F.when(F.col("refs") < 0, F.raise_error(F.lit("a document was deleted that had not been inserted")).cast("bigint")).otherwise(F.col("refs")))
        change.write.parquet(f"{path}/all")
        whole = self.spark.read.schema("high bigint, low bigint, refs bigint, was bigint").parquet(f"{path}/all")
        shards = max(self.shards, 16, -(-whole.count() // SHARD_KEYS))
        whole.withColumn("shard", F.pmod("high", F.lit(shards)).cast("int")).write.parquet(f"{path}/counts")
        sharded = self.spark.read.schema("high bigint, low bigint, refs bigint, was bigint, shard int").parquet(f"{path}/counts")
        old = self.filters() if self.path and shards == self.shards else self.spark.createDataFrame([], _FILTERS)
        sharded.groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(_refreshed(self.min_docs), _FILTERS).write.parquet(f"{path}/filters")
        return LineIndex(self.spark, path, shards, self.min_docs, self.min_chars)

    def rewrite(self, docs: DataFrame, text: str = "text", keep: list[str] | None = None, names: tuple[str, str, str] = ("kept", "n_lines", "n_dropped")) -> DataFrame:
        """The columns ``keep`` and, by the given names, the text without shared lines, its lines, and those dropped.

        Exact for the lines of indexed documents. Null or empty texts are one empty line and keep it; an empty key
        is never dropped; a text that loses all its lines is left empty; repeated rows stay. While all filters together
        have BROADCAST bytes or less they are broadcast and texts are rewritten where they are read. Beyond it, the
        most common keys alone are broadcast, as many as BROADCAST bytes hold; the others' digests go to their shard's
        filter, none of them common any more, and the places that it drops are joined back: texts move once.
        """
        keep = keep or []
        sizes = self.filters().agg(F.sum(F.length("cells") + F.length("exceptions")).alias("all")).first()["all"] or 0
        if sizes <= BROADCAST:
            return self._where_read(docs, text, keep, names)
        return self._joined(docs, text, keep, names)

    def _where_read(self, docs: DataFrame, text: str, keep: list[str], names: tuple[str, str, str]) -> DataFrame:
        filters = {r.shard: (r.buckets, bytes(r.cells), bytes(r.exceptions)) for r in self.filters().collect()}
        sent = self.spark.sparkContext.broadcast(filters)
        shards, min_chars = self.shards, self.min_chars
        made: dict[int, _Exact] = {}
        data = unused(docs, "data")

        def run(rows: dict[str, list]) -> dict[str, list]:
            if not made:
                made.update({s: _Exact.of(*x) for s, x in sent.value.items()})
            split, owner, place, high, low = _places(rows.pop(data), min_chars)
            gone: list[set[int]] = [set() for _ in split]
            shard = np.mod(high, shards)
            order = np.argsort(shard, kind="stable")
            bounds = np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) != 0, [True]])) if len(order) else []
            for a, b in zip(bounds, bounds[1:], strict=False):
                if found := made.get(int(shard[order[a]])):
                    at = order[a:b]
                    for k in at[found.holds(high[at], low[at])].tolist():
                        gone[owner[k]].add(int(place[k]))
            return rows | _rest(split, gone, names)

        now = docs.select(*keep, F.col(text).cast("binary").alias(data))
        return map_rows(now, _kept_schema(now, keep, names), run)

    def _common(self) -> np.ndarray:
        """The digests of the keys with most references, sorted, in BROADCAST bytes at most."""
        least = max(self.min_docs, 64)
        while True:
            common = self.counts().where(F.col("refs") >= least).select("high", "low")
            if common.count() * 16 <= BROADCAST:
                break
            least *= 4
        found = np.array([(r.high, r.low) for r in common.collect()], np.int64).reshape(-1, 2)
        return found[np.lexsort((found[:, 1], found[:, 0]))]

    def _joined(self, docs: DataFrame, text: str, keep: list[str], names: tuple[str, str, str]) -> DataFrame:
        bounded_batches(self.spark)
        sent = self.spark.sparkContext.broadcast(self._common())
        shards, min_chars = self.shards, self.min_chars

        def is_common(high: np.ndarray, low: np.ndarray) -> np.ndarray:
            known = sent.value
            pairs = np.dtype([("high", np.int64), ("low", np.int64)])
            sorted_, asked = np.ascontiguousarray(known).view(pairs).ravel(), np.ascontiguousarray(np.stack([high, low], axis=1)).view(pairs).ravel()
            at = np.searchsorted(sorted_, asked)
            return (at < len(sorted_)) & (sorted_[np.minimum(at, len(sorted_) - 1)] == asked) if len(sorted_) else np.zeros(len(asked), bool)

        def probe(rows: dict[str, list]) -> dict[str, list]:
            _, owner, place, high, low = _places(rows["_data"], min_chars)
            some = np.flatnonzero(~is_common(high, low))
            own = owner[some].tolist()
            return {"_d0": [rows["_d0"][i] for i in own], "_d1": [rows["_d1"][i] for i in own], "at": place[some].tolist(), "high": high[some].tolist(), "low": low[some].tolist(), "shard": np.mod(high[some], shards).tolist()}

        data, at, first, second = (unused(docs, x) for x in ("data", "at", "first", "second"))
        rows = docs.select(*keep, F.col(text).cast("binary").alias(data))
        rows = rows.withColumns(dict(zip((first, second), _digests(F.col(data)), strict=True)))
        probes = map_rows(rows.select(F.col(first).alias("_d0"), F.col(second).alias("_d1"), F.col(data).alias("_data")), f"{_HITS}, high bigint, low bigint, shard int", probe)
        hits = probes.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInArrow(_probed, _HITS)
        places = hits.distinct().groupBy(F.col("_d0").alias(first), F.col("_d1").alias(second)).agg(F.collect_list("at").alias(at))

        def run(rows: dict[str, list]) -> dict[str, list]:
            split, owner, place, high, low = _places(rows.pop(data), min_chars)
            gone = [set(x or ()) for x in rows.pop(at)]
            for k in np.flatnonzero(is_common(high, low)).tolist():
                gone[owner[k]].add(int(place[k]))
            return rows | _rest(split, gone, names)

        now = rows.join(stored(places, "places"), [first, second], "left").select(*keep, data, at)
        return map_rows(now, _kept_schema(now, keep, names), run)


def _kept_schema(rows: DataFrame, keep: list[str], names: tuple[str, str, str]) -> str:
    return "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep) + f"`{names[0]}` string, `{names[1]}` bigint, `{names[2]}` bigint"

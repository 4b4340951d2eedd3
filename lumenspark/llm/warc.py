"""WARC archives: written whole by Spark's writers, normalised to one gzip member per record, indexed and read back.

A writer that compresses whole files gives archives that are one gzip stream each: to reach one record, everything
before it must be inflated. The normaliser inflates such a stream once, cuts it into records and rewrites each as a
member of its own, whose header tells the member's length. The sidecar index then is made by going from header to
header, and any record can be read from its offset alone.

All files are written by Spark's own writers, so any store will do and lost tasks leave nothing behind. Records are
rows of a text file: the two line ends that close a record are the line separator. A member ends in the highest byte
of its uncompressed length, which is 0 below 16 MiB, so members are rows parted by that byte; longer records are
followed by an empty member.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.llm.common import stored, tidy

#: Fixed values of the format.
CLOSE = b"\r\n\r\n"
GZIP = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff"  # no time of writing, an extra field, any system
LENGTH_FIELD = b"SL"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this many bytes are always written out; records of a file at most, and their bytes, about: a whole
#: file is one value to its reader; level of members.
LEAST = 100
RECORDS = 1 << 16
FILE = 64 << 20
LEVEL = 6


def with_record_types(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", least: int = LEAST) -> DataFrame:
    """(key, url, payload, digest, first): ``first`` is the response that a revisit refers to, null for a response.

    Of rows with equal payloads of at least ``least`` bytes the smallest key is the response, and so are rows that
    repeat that key; where all keys are null, all are responses. A null html is an empty payload. Only digests of
    payloads that occur twice are joined back, from a written table whose size the planner knows.
    """
    payload = F.coalesce(F.col(html), F.lit("")).alias("payload")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), payload)
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("large", F.octet_length("payload") >= least)
    equal = rows.where("large").groupBy(F.col("digest").alias("same")).agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    equal = stored(equal.select("same", "least"), "equal-payloads")
    joined = rows.join(equal, (rows.digest == equal.same) & F.col("large"), "left")
    first = F.when(F.col("least").isNotNull() & ~F.col("key").eqNullSafe(F.col("least")), F.col("least"))
    return joined.select("key", "url", "payload", "digest", first.alias("first"))


def _record_id(key: Column, digest: Column) -> Column:
    """A URN of a UUID that the key and the payload determine."""
    h = F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def _escaped(key: Column) -> Column:
    """A key that is text has its line ends and percent signs escaped, as the reader undoes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(key.cast("string"), "%", "%25"), "\r", "%0D"), "\n", "%0A")


def _unescaped(value: bytes | None) -> str | None:
    return value and value.decode().replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(key: Column, url: Column, payload: Column, digest: Column, first: Column, date: str) -> Column:
    """A WARC record as text, without the two line ends that close it. A revisit has the response's head only."""
    end = F.lit("\r\n")
    revisit = first.isNotNull()

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, end), F.lit(""))

    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), end, end)
    block = F.concat(head, F.when(revisit, F.lit("")).otherwise(payload))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", _record_id(key, digest)), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(url, r"[\x00-\x20]", "%20")), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        line("WARC-Profile", F.when(revisit, PROFILE)), line("WARC-Refers-To", F.when(revisit, _record_id(first, digest))), line("WARC-Page-ID", _escaped(key)), line("WARC-Refers-To-Page-ID", _escaped(first)),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", F.octet_length(block).cast("string")), end, block,
    )


def write_whole(records: DataFrame, path: str, each: float = 0) -> None:
    """Archives of one gzip stream each, a file for each partition and RECORDS, or fewer if they have ``each`` bytes;
    ``records`` has one string column."""
    most = max(1, min(RECORDS, int(FILE / max(1, each))))
    records.write.option("compression", "gzip").option("lineSep", CLOSE.decode()).option("maxRecordsPerFile", most).text(path)


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member whose header holds the member's length, and whose last byte is 0."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    size = len(GZIP) + 2 + 8 + len(body) + 8
    made = GZIP + struct.pack("<H2sHI", 8, LENGTH_FIELD, 4, size) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    return made if made[-1] == 0 else made + member(b"")


def inflated(content: memoryview, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of one or more gzip members, piece by piece."""
    at, size, flow = 0, len(content), None
    while at < size:
        flow = flow or zlib.decompressobj(31)
        fed = content[at : at + step]
        at = min(at + step, size)
        while True:  # what a little input holds may be long: it comes out 4 steps at a time
            piece = flow.decompress(fed, 4 * step)
            yield piece
            fed = flow.unconsumed_tail
            if flow.eof or (not fed and len(piece) < 4 * step):
                break
        if flow.eof:
            at -= len(flow.unused_data)
            flow = None
    if flow is not None:
        raise ValueError("an archive ends within a member")


def cut_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, closing line ends included, from the pieces of a stream; holds one record at most."""
    held, at, whole = bytearray(), 0, None
    for piece in pieces:
        held += piece
        while True:
            if whole is None:
                stop = held.find(CLOSE, at)
                if stop < 0:
                    break
                whole = stop + len(CLOSE) + _content_length(bytes(held[at:stop])) + len(CLOSE)
            if len(held) < whole:
                break
            yield bytes(held[at:whole])
            at, whole = whole, None
        if whole is not None:
            whole -= at
        del held[:at]
        at = 0
    if held:
        raise ValueError("an archive ends within a record")


def _content_length(head: bytes) -> int:
    return int(next(x.split(b":", 1)[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))


def normalise(spark: SparkSession, source: str, target: str, level: int = LEVEL) -> None:
    """Rewrites the archives under ``source`` with a member for each record, in the order they had.

    An empty archive gives an empty one; equal records stay as many as they are; one that ends early is an error.
    """
    files = spark.read.format("binaryFile").load(source).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held, size = [], 0
                for data in cut_records(inflated(memoryview(batch.column(0)[i].as_buffer()).cast("B"))):
                    held.append(member(data, level)[:-1])  # the writer adds the last byte
                    size += len(held[-1])
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["member"])
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["member"])
        tidy()

    made = files.mapInArrow(run, "member binary")
    made.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(target)


def member_size(content: memoryview, at: int) -> int:
    if content[at + 12 : at + 14] != LENGTH_FIELD:
        raise ValueError("this archive is not normalised")
    return struct.unpack("<I", content[at + 16 : at + 20])[0]


def members(content: memoryview) -> Iterator[tuple[int, int]]:
    """(start, size) of each member that holds a record, from header to header."""
    at = 0
    while at < len(content):
        size = member_size(content, at)
        if content[at : at + size] != EMPTY:
            yield at, size
        at += size


def write_index(spark: SparkSession, archives: str, target: str) -> DataFrame:
    """The sidecar: (path, start, size) of every record's member, found by going from header to header."""
    files = spark.read.format("binaryFile").load(archives).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                content = memoryview(batch.column(1)[i].as_buffer()).cast("B")
                start, size = map(list, zip(*members(content), strict=True)) if len(content) else ([], [])
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(start), pa.string()), pa.array(start, pa.int64()), pa.array(size, pa.int64())], names=["path", "start", "size"])

    files.mapInArrow(run, "path string, start bigint, size bigint").write.parquet(target)
    return spark.read.schema("path string, start bigint, size bigint").parquet(target)


EMPTY = member(b"")


def read(spark: SparkSession, archives: str, index: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """One row for each record: page_id, record_type, payload_bytes, payload_digest, refers_to, payload.

    Every member is inflated from its offset alone. Without an index all records are read where their files are, from
    header to header; with one, the records that it lists, and only the files that hold some of them are moved. Bytes
    and digest are of the full payload: a response's are taken from what was read, and must be what its head says; a
    revisit's are those of its head. ``payload`` is null for revisits, and without ``payloads``.
    """
    files = spark.read.format("binaryFile").load(archives).select("path", "content")
    if index is None:
        joined = files.select("content", F.lit(None).cast("array<bigint>").alias("start"))
    else:
        places = index.groupBy(F.col("path").alias("at")).agg(F.sort_array(F.collect_list("start")).alias("start"))
        joined = files.join(places, files.path == places.at).select("content", "start")
    schema = pa.schema([("page_id", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for i in range(batch.num_rows):
                content = memoryview(batch.column(0)[i].as_buffer()).cast("B")
                rows, held = [], 0
                listed = batch.column(1)[i].as_py()
                for start, size in members(content) if listed is None else ((at, member_size(content, at)) for at in listed):
                    data = zlib.decompress(content[start : start + size], 31)
                    head, rest = data.split(CLOSE, 1)
                    fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
                    http, payload = rest[: -len(CLOSE)].split(CLOSE, 1)
                    said, digest = _content_length(http), fields[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode()
                    kind = fields[b"WARC-Type"].decode()
                    if kind == "response" and (len(payload) != said or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError("a payload is not what its record says")
                    key, first = fields.get(b"WARC-Page-ID"), fields.get(b"WARC-Refers-To-Page-ID")
                    rows.append((_unescaped(key), kind, said, digest, _unescaped(first), payload if payloads and kind == "response" else None))
                    held += len(payload) if payloads else 64
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                del content
        tidy()

    made = joined.mapInArrow(run, "page_id string, record_type string, payload_bytes bigint, payload_digest string, refers_to string, payload binary")
    return made.withColumn("payload", F.col("payload").cast("string")) if payloads else made.drop("payload")


def archive(pages: DataFrame, path: str, key: str = "page_id", html: str = "html", url: str = "url", date: str = "1970-01-01T00:00:00Z", level: int = LEVEL) -> DataFrame:
    """Writes ``path``/whole, ``path``/archives and the sidecar ``path``/index, which it returns.

    Other columns don't matter; repeated rows are records of their own; no rows give archives without records.
    """
    spark = pages.sparkSession
    typed = with_record_types(pages, key, html, url)
    each = pages.agg(F.avg(F.octet_length(html)).alias("n")).first().n or 0
    write_whole(typed.select(record(*(F.col(c) for c in ("key", "url", "payload", "digest", "first")), date)), f"{path}/whole", each)
    normalise(spark, f"{path}/whole", f"{path}/archives", level)
    return write_index(spark, f"{path}/archives", f"{path}/index")

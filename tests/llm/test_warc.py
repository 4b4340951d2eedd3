import gzip
import hashlib
import io

import pytest

from lumenspark.llm import warc
from lumenspark.llm.common import fresh_path


def brute(rows):
    first = {}
    for k, h in rows:
        h = (h or "").encode()
        if len(h) >= 100 and k is not None:
            first[h] = min(first.get(h, k), k)
    out = []
    for k, h in rows:
        h = (h or "").encode()
        f = first.get(h)
        again = f is not None and f != k
        out.append((k, len(h), hashlib.sha256(h).hexdigest(), "revisit" if again else "response", f if again else None))
    return out


def test_members_and_streams():
    data = b"WARC/1.1\r\nContent-Length: 5\r\n\r\na\r\n\r\n\r\n\r\n"
    other = b"WARC/1.1\r\ncontent-length: 0\r\n\r\n\r\n\r\n"
    one = gzip.compress(data + other + data)
    assert list(warc.cut_records(warc.inflated(memoryview(one), 7))) == [data, other, data]
    many = warc.member(data) + warc.member(other)
    assert gzip.decompress(many) == data + other and list(warc.cut_records(warc.inflated(memoryview(many), 5))) == [data, other]
    big = bytes(17 << 20)
    made = warc.member(big, 1)
    assert made[-1] == 0 and gzip.decompress(made) == big
    with pytest.raises(ValueError):
        list(warc.cut_records(iter([data[:-1]])))


def test_edge_rows(spark):
    long = "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 7\r\n\r\n</p>" * 20
    rows = [(5, long), (3, long), (3, long), (9, None), (8, ""), (7, "x" * 99), (6, "x" * 99), (4, "y" * 100), (2, "y" * 100), (None, long), (1, "\0" * 200), (11, "z" * (17 << 20)), (10, "z" * (17 << 20))]
    pages = spark.createDataFrame([(k, f"http://a/ b\r\n{k}" if k else None, h, "response") for k, h in rows], "page_id bigint, url string, html string, record_type string")
    path = fresh_path(spark, "warc")
    index = warc.archive(pages.repartition(3), path)
    got = warc.read(spark, f"{path}/archives", index).collect()
    assert sorted(map(str, got)) == sorted(map(str, warc.read(spark, f"{path}/archives").collect()))
    one = index.limit(1)
    assert warc.read(spark, f"{path}/archives", one).count() == 1
    as_row = [(r.page_id and int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in got]
    assert sorted(as_row, key=str) == sorted(brute(rows), key=str)
    assert sorted(r.payload for r in got if r.payload is not None) == sorted((h or "") for (k, h), b in zip(rows, brute(rows), strict=True) if b[3] == "response")
    # the files are gzip to anyone, and each indexed member is a record of its own
    import os

    folder = f"{path}/archives".removeprefix("file:")
    whole = b"".join(gzip.open(os.path.join(folder, f)).read() for f in os.listdir(folder) if f.startswith("part-"))
    assert whole.count(b"WARC-Record-ID") == len(rows)
    for r in index.collect():
        with open(r.path.removeprefix("file:"), "rb") as f:
            f.seek(r.start)
            assert gzip.GzipFile(fileobj=io.BytesIO(f.read(r.size))).read().startswith(b"WARC/1.1")
    none = fresh_path(spark, "warc")
    assert warc.read(spark, f"{none}/archives", warc.archive(pages.where("false"), none)).count() == 0


def test_keys_of_text(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE", 300)
    keys = ["a\r\nWARC-Type: revisit", "100%0A", "", "z", None]
    path = fresh_path(spark, "warc")
    index = warc.archive(spark.createDataFrame([(k, "h" * 150, "u") for k in keys], "page_id string, html string, url string").coalesce(1), path)
    got = warc.read(spark, f"{path}/archives", index).collect()
    assert sorted((str(r.page_id), str(r.refers_to)) for r in got) == sorted((str(k), "None" if k == "" else "") for k in keys)
    assert index.select("path").distinct().count() == 3  # two records a file


def test_query(spark):
    from lumenspark.llm.queries_d import op5_warc

    folder = "/root/testdata/sf0.01"
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    assert sorted(map(tuple, op5_warc(spark, folder).collect())) == sorted(brute(rows))

"""WARC archives: round trips, odd rows, chunks, foreign files."""

import gzip
import hashlib

import pyarrow as pa
import pytest

from tickloom.llm import warc


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, size int, type string").repartition(3)


BIG = "<p>é\r\n\r\nWARC/1.1\r\n" * 60
ROWS = [
    (1, "http://a/\r\nWARC-Type: x", BIG), (7, None, BIG), (7, "http://b/ü", BIG), (None, "u", BIG), (3, "http://c", "small"), (4, "http://c", "small"), (5, "", None), (6, "http://d", ""),
    (8, "http://e", "x" * 300_000), (9, "http://e", "y" * 999), (10, "http://e", "y" * 999), (None, "n", "z" * 2_000), (None, "n", "z" * 2_000), *[(100 + i, "hot", "hot" * 400) for i in range(60)],
]


def wanted(rows):
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            first[h] = max(first.get(h, i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        top = first.get(h)
        revisits = top is not None and i != top
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisits else "response", top if revisits else None))
    return sorted(map(str, out))


@pytest.mark.parametrize(("hot", "chunk", "most"), [(1 / 1000, 1 << 16, 1 << 27), (1 / 4, 7, 5_000)])
def test_archive(spark, tmp_path, monkeypatch, hot, chunk, most):
    monkeypatch.setattr(warc, "HOT", hot)
    got = warc.summary(warc.archive(pages(spark, ROWS), f"file://{tmp_path}/w", chunk_bytes=chunk, archive_bytes=most))
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got.collect()) == wanted(ROWS)


def test_payloads_come_back(spark, tmp_path):
    """All bytes of every response, in chunks whose digests are those of the payload so far."""
    warc.archive(pages(spark, ROWS), f"{tmp_path}/w", archive_bytes=100_000)
    read = spark.read.format("warc").option("chunk_bytes", "1000").load(f"{tmp_path}/w").where("type = 'response'").collect()
    assert max(r.size for r in read) == 1000
    parts, found = {}, []
    for r in sorted(read, key=lambda r: (r.record_id, r.chunk)):
        if r.record_id in ("urn:page:", "urn:page:7"):
            continue
        own = parts.get(r.record_id, b"") + bytes(r.data)
        assert r.offset + r.size == len(own) and r.digest == hashlib.sha1(own).hexdigest()
        parts[r.record_id] = own
        found += [(r.record_id, own.decode())] if r.last else []
    last = {"urn:page:8": "x" * 300_000, "urn:page:3": "small", "urn:page:4": "small", "urn:page:5": "", "urn:page:6": "", "urn:page:9": "y" * 999, "urn:page:10": "y" * 999, "urn:page:159": "hot" * 400}
    assert dict(found) == last and len(list((tmp_path / "w").glob("*.warc.gz"))) > 1


def test_uncommitted_archives_are_not_read(spark, tmp_path):
    warc.archive(pages(spark, ROWS[:3]), f"{tmp_path}/w")
    (tmp_path / "w" / "lost.warc.gz").write_bytes(gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n"))
    assert spark.read.format("warc").load(f"{tmp_path}/w").where("last").count() == 3


@pytest.mark.parametrize("packed", [False, True])
def test_foreign_archives(packed):
    """Records of other writers, packed by record or not at all, with fields in any order and case."""
    records = [b"WARC/1.0\r\ncontent-length: 5\r\nwarc-type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\n\r\nhello\r\n\r\n", b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:2>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 90021\r\n\r\nHTTP/1.1 200 OK\r\n\r\n\r\n" + b"q" * 90_000 + b"\r\n\r\n"]
    records[1] = records[1].replace(b"90021", str(len(b"HTTP/1.1 200 OK\r\n\r\n\r\n") + 90_000).encode())
    data = b"".join(gzip.compress(r) if packed else r for r in records)
    got = list(warc.records_of(pa.BufferReader(data), 40_000, True))
    assert [(r[0], r[1], r[6], r[8], r[11]) for r in got] == [("urn:uuid:1", "warcinfo", 0, 5, True), ("urn:uuid:2", "response", 0, 40_000, False), ("urn:uuid:2", "response", 1, 40_000, False), ("urn:uuid:2", "response", 2, 10_002, True)]
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records_of(pa.BufferReader(b"".join(records)[:-9_000]), 40_000, True))


def test_writer_rejects_other_payloads(spark, tmp_path):
    spark.dataSource.register(warc.Warc)
    bad = spark.createDataFrame([("a", "response", None, None, 3, "0" * 40, b"abc")], "record_id string, type string, uri string, refers_to string, payload_bytes long, payload_digest string, payload binary")
    with pytest.raises(Exception, match="are not its payload"):
        warc.chunked(bad).write.format("warc").mode("append").save(f"{tmp_path}/w")


def test_empty(spark, tmp_path):
    assert warc.summary(warc.archive(pages(spark, ROWS).limit(0), f"{tmp_path}/w")).count() == 0

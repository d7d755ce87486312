"""WARC archives as a Spark data source whose rows are chunks of records.

A payload is a row for each chunk: record identifier, chunk number, bytes, and
the digest of the payload up to there. Writers and readers take one chunk at a
time, so that none holds a whole record, however long.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import shared_dir, small_batches, table

#: Bytes of a chunk; of the chunks that are handed on at once; of an archive, beyond which the next record begins another.
CHUNK, BATCH, ARCHIVE = 1 << 16, 4 << 20, 128 << 20
#: Payloads of so many bytes are stored once.
LEAST = 1000
#: Digests that this share of all records holds are joined by broadcast; there are at most 1 / HOT of them.
HOT = 1 / 1000
DATE = "1970-01-01T00:00:00Z"
_HEAD = "record_id string, type string, uri string, refers_to string, payload_bytes long, payload_digest string, "
#: Rows of the data source. digest: SHA-1 of the payload up to the end of the chunk; offset: its first byte; size: its bytes.
SCHEMA = _HEAD + "chunk int, offset long, size int, data binary, digest string, last boolean"
_ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}[c.split()[1]]) for c in SCHEMA.split(", ")])
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _grouped(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of about BATCH bytes of data."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[9] or b"") + 256
        if size >= BATCH:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _chunker(chunk_bytes: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            payloads = batch.column(6)
            heads = zip(*[c.to_pylist() for c in batch.columns[:6]], strict=True)
            for i, head in enumerate(heads):
                whole = payloads[i].as_buffer()
                view = memoryview(whole) if whole is not None else memoryview(b"")
                digest = hashlib.sha1()
                for n, at in enumerate(range(0, max(1, len(view)), chunk_bytes)):
                    part = view[at : at + chunk_bytes]
                    digest.update(part)
                    yield (*head, n, at, len(part), bytes(part), digest.hexdigest(), at + chunk_bytes >= len(view))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _grouped(rows(batches))

    return run


def chunked(records: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """Rows of SCHEMA from records (record_id, type, uri, refers_to, payload_bytes, payload_digest, payload); a record's chunks follow each other. An empty or null payload is one empty chunk."""
    small_batches(records.sparkSession)
    payload = F.col("payload").cast("binary")
    return records.select("record_id", "type", "uri", "refers_to", "payload_bytes", "payload_digest", payload.alias("payload")).mapInArrow(_chunker(chunk_bytes), SCHEMA)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"^\w+:", path) else f"file://{path}")


def _b32(hex_: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_)).decode()


def _uri(text: str) -> str:
    """text with all but printable ASCII escaped, so that it stays in its header line."""
    return quote(text, safe="".join(map(chr, range(33, 127))))


def header(record_id: str, type_: str, uri: str | None, refers_to: str | None, size: int, digest: str) -> bytes:
    """The lines before a payload: those of the record, then those of the response in its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n"
    block = len(http) + (size if type_ != "revisit" else 0)
    lines = ["WARC/1.1", f"WARC-Type: {type_}", f"WARC-Record-ID: <{_uri(record_id)}>", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {_uri(uri)}"] if uri is not None else []
    lines += [f"WARC-Refers-To: <{_uri(refers_to)}>", f"WARC-Profile: {PROFILE}"] if type_ == "revisit" else []
    lines += [f"WARC-Payload-Digest: sha1:{_b32(digest)}", f"WARC-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {block}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    """Each task writes archives under names of its own; those of committed tasks are listed in a file of the job, which readers go by."""

    def __init__(self, options: dict) -> None:
        self.path, self.most, self.level = options["path"], int(options.get("archive_bytes", ARCHIVE)), int(options.get("level", 1))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, top = _opened(self.path)
        where.create_dir(top)
        files: list[str] = []
        out = member = None
        left, size, revisit, wanted = 0, 0, False, ""
        for batch in iterator:
            for r in batch.to_pylist():
                if r["chunk"] == 0:
                    if left:
                        raise ValueError("a record ends before its payload does")
                    if out is None or size >= self.most:
                        if out is not None:
                            out.close()
                        files.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = where.open_output_stream(f"{top}/{files[-1]}", compression=None), 0
                    member = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                    revisit, left, wanted = r["type"] == "revisit", r["payload_bytes"], r["payload_digest"]
                    packed = member.compress(header(r["record_id"], r["type"], r["uri"], r["refers_to"], left, wanted))
                else:
                    packed = b""
                if revisit:
                    left = 0
                else:
                    left -= r["size"]
                    packed += member.compress(r["data"])
                    if left < 0 or (r["last"] and (left or r["digest"] != wanted)):
                        raise ValueError(f"the chunks of {r['record_id']} are not its payload")
                if r["last"]:
                    packed += member.compress(b"\r\n\r\n") + member.flush()
                out.write(packed)
                size += len(packed)
        if left:
            raise ValueError("a record ends before its payload does")
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        where, top = _opened(self.path)
        where.create_dir(top)
        with where.open_output_stream(f"{top}/_archives-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps([name for m in messages if m for name in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        where, top = _opened(self.path)
        for name in [name for m in messages if m for name in m.files]:
            where.delete_file(f"{top}/{name}")


class _Stream:
    """Bytes of an archive in order, members of gzip unpacked; at most a few chunks are held."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.held, self.packed, self.rest = file, b"", None, b""

    def more(self) -> bool:
        raw = self.rest or self.file.read(CHUNK)
        self.rest = b""
        if not raw:
            return False
        if self.packed is None:
            self.packed = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else False
        if self.packed is False:
            self.held += raw
            return True
        self.held += self.packed.decompress(raw, 4 * CHUNK)
        if self.packed.eof:
            self.rest, self.packed = self.packed.unused_data, zlib.decompressobj(31)
        else:
            self.rest = self.packed.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What lies before the next mark, which is passed; None at the end."""
        at = self.held.find(mark)
        while at < 0:
            if not self.more():
                return None
            at = self.held.find(mark)
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def take(self, most: int) -> bytes:
        """At most so many bytes, all of them unless the archive ends."""
        while len(self.held) < most and self.more():
            pass
        out, self.held = self.held[:most], self.held[most:]
        return out


def _fields(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode("utf-8", "replace").split("\r\n")[1:])}


def records_of(file: pa.NativeFile, chunk_bytes: int, with_data: bool) -> Iterator[tuple]:
    """Rows of SCHEMA of one archive, packed or not."""
    stream = _Stream(file)
    while (lines := stream.until(b"\r\n\r\n")) is not None:
        h = _fields(lines.lstrip(b"\r\n"))
        left = int(h.get("content-length", "0"))
        if h.get("content-type", "").startswith("application/http"):
            http = stream.until(b"\r\n\r\n") or b""
            left -= len(http) + 4
        known = h.get("warc-payload-digest", "").rpartition("sha1:")[2]
        head = (
            h.get("warc-record-id", "").strip("<>"), h.get("warc-type"), h.get("warc-target-uri"), h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None,
            int(h["warc-payload-length"]) if "warc-payload-length" in h else None, base64.b32decode(known).hex() if known else None,
        )
        digest, n, at = hashlib.sha1(), 0, 0
        while n == 0 or left:
            part = stream.take(min(left, chunk_bytes))
            if len(part) < min(left, chunk_bytes):
                raise ValueError(f"the archive ends within {head[0]}")
            left -= len(part)
            digest.update(part)
            yield (*head, n, at, len(part), part if with_data else None, digest.hexdigest(), left == 0)
            n, at = n + 1, at + len(part)
        stream.take(4)


@dataclass
class Archive(InputPartition):
    name: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.chunk, self.data = options["path"], int(options.get("chunk_bytes", CHUNK)), options.get("data", "true").lower() == "true"

    def partitions(self) -> list[Archive]:
        """An archive each: those that writers listed, or where there is no list, all *.warc and *.warc.gz."""
        where, top = _opened(self.path)
        names = [f.base_name for f in where.get_file_info(fs.FileSelector(top))]
        lists = [n for n in names if n.startswith("_archives-")]
        if not lists:
            return [Archive(n) for n in sorted(names) if n.endswith((".warc", ".warc.gz"))]
        out = []
        for n in sorted(lists):
            with where.open_input_stream(f"{top}/{n}", compression=None) as f:
                out += [Archive(x) for x in json.loads(f.read())]
        return out

    def read(self, partition: Archive | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        where, top = _opened(self.path)
        with where.open_input_stream(f"{top}/{partition.name}", compression=None, buffer_size=1 << 20) as f:
            yield from _grouped(records_of(f, self.chunk, self.data))


class Warc(DataSource):
    """`spark.read.format("warc")` and `df.write.format("warc")` of rows of SCHEMA.

    Options: path (any that pyarrow opens, shared by all executors), chunk_bytes
    and data (false: no payload bytes, digests only) to read, archive_bytes and
    level (of compression) to write. Written rows must have a record's chunks in
    order, one after the other in one partition; all of them but those of a
    revisit must make up payload_bytes and payload_digest.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


def deduplicated(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Records of pages (page_id, url, html): record_id, type, uri, refers_to, payload_bytes, payload_digest, payload.

    Of equal payloads of `least` bytes or more, the one of the largest page_id is a
    response and all others revisit it; shorter ones are responses. A digest that
    many records share is found by a broadcast join of the few such; all other
    records are joined by digest, those that need no look-up under keys of their own.
    """
    size, digest = F.octet_length("payload"), F.sha1(F.encode("payload", "UTF-8"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("uri"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    own = own.withColumn("payload_bytes", size.cast("long")).withColumn("payload_digest", digest)
    sums = own.groupBy("payload_digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first"), F.first("payload_bytes").alias("size"))
    n = pages.count()
    shared = sums.where((F.col("n") > 1) & (F.col("size") >= least) & F.col("first").isNotNull())
    hot = shared.where(F.col("n") > n * HOT).select("payload_digest", F.col("first").alias("hot_first"))  # at most 1 / HOT rows
    rest = shared.where(F.col("n") <= n * HOT).select(F.col("payload_digest").alias("key"), "first")
    alone = F.concat(F.lit("-"), F.xxhash64(F.monotonically_increasing_id()).cast("string"))
    out = own.join(F.broadcast(hot), "payload_digest", "left")
    out = out.withColumn("key", F.when((F.col("payload_bytes") >= least) & F.col("hot_first").isNull(), F.col("payload_digest")).otherwise(alone)).join(rest, "key", "left")
    first = F.coalesce("hot_first", "first")
    revisit = first.isNotNull() & (F.col("payload_bytes") >= least) & (F.col("page_id").isNull() | (F.col("page_id") < first))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return out.select(
        name(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("type"), "uri", F.when(revisit, name(first)).alias("refers_to"),
        "payload_bytes", "payload_digest", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, path: str, least: int = LEAST, chunk_bytes: int = CHUNK, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html, any others) under path and gives the chunks read back, without their bytes.

    A null html is an empty payload, a null url has no target, a null page_id an
    identifier without number; among equal payloads it revisits, but is never
    revisited, and if all are null, all are responses. Repeated rows are a record
    each; those with the largest page_id are all responses. Payloads of any length
    go chunk by chunk; characters of a url other than printable ASCII are escaped.
    Columns beside the three are ignored; an empty table gives no record.
    """
    spark = pages.sparkSession
    spark.dataSource.register(Warc)
    rows = chunked(deduplicated(pages, least), chunk_bytes)
    rows.write.format("warc").mode("append").option("archive_bytes", str(archive_bytes)).save(path)
    return spark.read.format("warc").option("data", "false").option("chunk_bytes", str(chunk_bytes)).load(path)


def summary(chunks: DataFrame) -> DataFrame:
    """A row for each page of an archive, from the last chunk of its record: what was read back, or what a revisit says of the payload it stands for."""
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    id_ = lambda c: F.when(number(c) != "", number(c).cast("long"))
    revisit = F.col("type") == "revisit"
    size = F.when(revisit, F.col("payload_bytes")).otherwise(F.col("offset") + F.col("size"))
    return chunks.where("last").select(
        id_("record_id").alias("page_id"), size.alias("payload_bytes"), F.when(revisit, F.col("payload_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), id_("refers_to").alias("refers_to"),
    )


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(archive(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"))


SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
f as (select *, max(page_id) over (partition by payload_digest) as first from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id < first then 'revisit' else 'response' end as record_type,
 case when payload_bytes >= 1000 and page_id < first then first end as refers_to from f
"""

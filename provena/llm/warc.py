"""WARC archives as a Python data source.

``spark.read.format("provena_warc").load(folder)`` plans one partition for each archive file, or several byte ranges of a large
one, takes equality filters on record_type and on header columns, and reads each record's header first: a record that
the filters drop, or whose payload is not asked for (option ``payload`` "false"), is skipped without inflating its
payload. Records are gzip members of their own; each names its compressed size in a gzip extra field, so that a reader
can step over it. Archives without that field are read too: such members are inflated to find their end, in pieces.

The writer gives every attempt its own file, and the files of committed tasks are listed in a manifest written once,
at the job's commit; readers follow the manifest, so files of lost or repeated attempts are never read. A folder
without a manifest is read whole. All files go through pyarrow's file systems, so the folder may be on any store that it opens.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, InputPartition, WriterCommitMessage

from provena.llm.common import scratch, written

#: Header columns and the WARC fields they come from.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "payload_length": "X-Payload-Length"}
SCHEMA = ", ".join([*(f"{c} string" for c in HEADERS), "payload binary"])
SPLIT, PIECE = 64 << 20, 1 << 20
_FIXED = b"\x1f\x8b\x08\x04"  # gzip with an extra field


def _fs(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field "sl" holds its own size and the inflated size."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = 10 + 2 + 4 + 16 + len(body) + 8
    extra = b"sl" + struct.pack("<HQQ", 16, size, len(data))
    return _FIXED + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(headers: dict[str, str | None], payload: bytes) -> bytes:
    """A WARC/1.1 record. Of header fields that are None there is no line."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Record:
    """A record's header; ``payload`` inflates the rest on demand."""

    def __init__(self, headers: dict[str, str], read):
        self.headers, self._read = headers, read

    def payload(self) -> bytes:
        return self._read()


def records(stream, start: int, end: int) -> Iterator[Record]:
    """The records whose members begin in [start, end) of a seekable ``stream``, headers parsed, payloads not.

    A member whose size is known is stepped over when its payload isn't asked for; of others the rest is inflated and dropped.
    """
    at = start
    while at < end:
        stream.seek(at)
        head = stream.read(min(4096, PIECE))
        if len(head) < 18:
            return
        size = None
        if head[:4] == _FIXED and head[12:14] == b"sl":
            size = struct.unpack_from("<Q", head, 16)[0]
        z, out, fed = zlib.decompressobj(31), bytearray(), head
        while b"\r\n\r\n" not in out and fed:
            out += z.decompress(fed, 4096)
            fed = z.unconsumed_tail or (b"" if z.eof else stream.read(4096))
        top, _, begun = bytes(out).partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in top.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
        length = int(headers.get("Content-Length", 0))
        ended: list[int] = []

        def finish(want: bool, z=z, fed=fed, begun=begun, length=length, ended=ended) -> bytes:
            kept, rest = [begun[:length]] if want else [], fed
            while not z.eof:
                piece = z.decompress(rest, PIECE)
                if want:
                    kept.append(piece)
                rest = z.unconsumed_tail
                if not rest and not z.eof:
                    rest = stream.read(64 << 10)
                    if not rest:
                        break
            ended.append(stream.tell() - len(z.unused_data))
            return b"".join(kept)[:length]

        yield Record(headers, lambda f=finish: f(True))
        if size is None:
            if not ended:
                finish(False)
            at = ended[0]
        else:
            at += size


class WarcPartition(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.equal: dict[str, str] = {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in HEADERS and f.value is not None and f.attribute[0] not in self.equal:
                self.equal[f.attribute[0]] = str(f.value)
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, root = _fs(self.folder)
        manifest = store.get_file_info(f"{root}/_manifest.json")
        if manifest.type == fs.FileType.File:
            with store.open_input_stream(manifest.path) as f:
                parts = json.loads(f.read())
        else:
            parts = [{"file": x.base_name, "size": x.size, "splits": [0]} for x in store.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]
        return [WarcPartition(f"{self.folder}/{p['file']}", a, b) for p in parts for a, b in zip(p["splits"], [*p["splits"][1:], p["size"]], strict=True) if a < b] or [WarcPartition("", 0, 0)]

    def read(self, part):
        if part.start >= part.end:
            return
        store, path = _fs(part.path)
        fields = list(HEADERS.values())
        wanted = [(HEADERS[c], v) for c, v in self.equal.items()]
        schema = pa.schema([*((c, pa.string()) for c in HEADERS), ("payload", pa.binary())])
        with store.open_input_file(path) as stream:
            rows, held = [], 0
            for r in records(stream, part.start, part.end):
                if any(r.headers.get(h) != v for h, v in wanted):
                    continue
                payload = r.payload() if self.payload else None
                rows.append([*(r.headers.get(f) for f in fields), payload])
                held += len(payload or b"") + 400
                if held > PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Committed(WriterCommitMessage):
    def __init__(self, files: list[dict]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Rows with the columns of the archive: record_id, record_type, target_uri, date, payload_digest, refers_to, payload_length, payload."""

    def __init__(self, options: dict):
        self.folder, self.level = options["path"], int(options.get("level", 6))

    def write(self, batches):
        store, root = _fs(self.folder)
        store.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        size, splits = 0, [0]
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in batches:
                heads = [batch.column(c).cast(pa.string()) for c in HEADERS]
                payloads = batch.column("payload")
                for i in range(batch.num_rows):
                    fields = {h: c[i].as_py() for h, c in zip(HEADERS.values(), heads, strict=True)}
                    data = member(record(fields, payloads[i].as_py() or b""), self.level)
                    if size - splits[-1] >= SPLIT:
                        splits.append(size)
                    out.write(data)
                    size += len(data)
        return Committed([{"file": name, "size": size, "splits": splits}] if size else [])

    def commit(self, messages):
        store, root = _fs(self.folder)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_manifest.json") as out:
            out.write(json.dumps([f for m in messages if m is not None for f in m.files]).encode())

    def abort(self, messages):
        store, root = _fs(self.folder)
        for m in messages:
            for f in m.files if m is not None else ():
                store.delete_file(f"{root}/{f['file']}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "provena_warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _record_id(c: str):
    """A record's URN from its page: the same on every attempt."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))


def write(pages: DataFrame, folder: str, least: int = 0, date: datetime | None = None) -> None:
    """Write a record for each page (page_id, url, html; null html is an empty payload) under ``folder``.

    Of payloads that are equal and have at least ``least`` bytes the one with the smallest page_id is a response; the
    others are revisits without payload that refer to it. Smaller ones are all responses. A row with a null page_id
    revisits any other; with nothing but null page_ids all are responses, as are repeated rows of the smallest page_id.
    """
    spark = pages.sparkSession
    register(spark)
    at = (date or datetime(2024, 1, 1, tzinfo=timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("key", F.sha1("payload"))
    first = rows.select("key", "page_id", F.octet_length("payload").alias("n")).where(F.col("n") >= least).groupBy("key").agg(F.min("page_id").alias("first"))
    rows = rows.join(written(first, "firsts"), "key", "left")
    revisit = (F.octet_length("payload") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    out = rows.withColumn("revisit", revisit).select(
        _record_id("page_id").alias("record_id"), F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit(at).alias("date"),
        F.concat(F.lit("sha1:"), base32(F.col("key"))).alias("payload_digest"), F.when(F.col("revisit"), _record_id("first")).alias("refers_to"),
        F.octet_length("payload").cast("string").alias("payload_length"), F.when(~F.col("revisit"), F.col("payload")).alias("payload"),
    )
    out.write.format("provena_warc").mode("append").save(folder)


def base32(hexed):
    """RFC 4648 base32 of 40 hexadecimal digits, as an expression: five digits are four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    group = lambda g: F.conv(F.substring(hexed, g * 5 + 1, F.lit(5)), 16, 10).cast("int")
    four = lambda v: F.concat(*(F.substring(letters, F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda g: four(group(g))), "")


def read(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("provena_warc").option("payload", str(payload).lower()).load(folder)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Per page (page_id, payload_bytes, payload_digest, record_type, refers_to), from archives written and read back.

    Responses are read with their payloads, whose length and digest are computed anew; revisits by their headers alone.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    write(pages, folder, least)
    page = F.expr("try_cast(regexp_extract(record_id, '^<urn:page:(.*)>$', 1) as bigint)")
    response = read(spark, folder).where("record_type = 'response'")
    response = response.select(page.alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisit = read(spark, folder, payload=False).where("record_type = 'revisit'")
    revisit = revisit.select(page.alias("page_id"), F.col("payload_length").cast("long").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", F.regexp_extract("refers_to", "^<urn:page:(.*)>$", 1).cast("long").alias("refers_to"))
    return response.unionByName(revisit)

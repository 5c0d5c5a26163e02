"""WARC archives as a PySpark Python data source, "quillon_warc".

Writing: each task writes one archive of gzip members, one per record, under a temporary name; commit renames the
archives of the attempts that succeeded, so a lost executor or a second attempt leaves nothing readable. Each member's
gzip header holds its compressed and its uncompressed length (extra field "sl").

Reading: partitions are byte ranges of files (option "split", bytes); a range owns the members that begin in it, found
by their magic number. Filters on record_type and target_uri are pushed down. Of a member only its first bytes are
inflated to parse the headers; if a pushed filter rejects the record, or payloads are not wanted (option
"payload" = "false"), the reader seeks past the member by its "sl" length and its payload is never inflated. Members
without "sl" (other writers') are inflated to find their end, but not decoded.

Columns: record_id, record_type, target_uri, refers_to, payload_digest (string), payload_bytes (long), payload (binary).
payload is null for revisits and where not wanted. Nulls in a column leave its header out and are read back as null.
A record's id is the page's, so rows that repeat a page_id, or have none, repeat or leave out the id of their records.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from quillon.llm.common import new_path, sized

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
#: Payloads of at least this many bytes are stored once.
REVISIT_BYTES = 1000
_MAGIC = b"\x1f\x8b\x08"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: Header fields of the columns, in the order written.
_FIELDS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Bytes",
}
_WRAPPED = ("record_id", "refers_to")


def _filesystem(path: str):
    """(filesystem, path) of a URI or local path."""
    return pafs.FileSystem.from_uri(path) if "://" in path else pafs.FileSystem.from_uri("file://" + os.path.abspath(path.removeprefix("file:")))


def pack(record: dict) -> bytes:
    """One record as a gzip member with its lengths in the header."""
    payload = record["payload"]
    block = b"" if payload is None else _HTTP % len(payload) + bytes(payload)
    head = ["WARC/1.1"]
    for name, field in _FIELDS.items():
        value = record[name]
        if value is not None:
            value = f"sha1:{value}" if name == "payload_digest" else f"<urn:quillon:{value}>" if name in _WRAPPED else str(value)
            head.append(f"{field}: {value.translate({13: 32, 10: 32})}")
    if record["record_type"] == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head += ["WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    whole, tail = 10 + 2 + 12 + len(body) + 8, struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)
    if max(whole, len(raw)) >> 32:  # too long for the field: a reader inflates the member to find its end
        return _MAGIC + b"\0" * 5 + b"\0\xff" + body + tail
    return _MAGIC + b"\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, whole, len(raw)) + body + tail


def parse_head(raw: bytes) -> tuple[dict, int, int] | None:
    """(columns, where the block begins, its length) from a record's first bytes; None while the headers are not whole."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    got = {}
    for line in raw[:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        got[k.strip().lower()] = v.strip()
    out = {name: got.get(field.lower()) for name, field in _FIELDS.items()}
    for name in _WRAPPED:
        if out[name]:
            out[name] = out[name].removeprefix("<urn:quillon:").removesuffix(">")
    if out["payload_digest"]:
        out["payload_digest"] = out["payload_digest"].removeprefix("sha1:")
    out["payload_bytes"] = int(out["payload_bytes"]) if out["payload_bytes"] else None
    return out, end + 4, int(got.get("content-length", 0))


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    name: str


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", 64 << 20))
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in ("record_type", "target_uri"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            else:
                yield f

    def partitions(self):
        fs, path = _filesystem(self.path)
        files = [x for x in fs.get_file_info(pafs.FileSelector(path)) if x.path.endswith(".warc.gz") and not os.path.basename(x.path).startswith((".", "_"))]
        return [Range(x.path, at, min(at + self.split, x.size)) for x in sorted(files, key=lambda x: x.path) for at in range(0, x.size, self.split)] or [Range("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        fs, _ = _filesystem(self.path)
        rows: list[dict] = []
        size = 0
        with fs.open_input_file(partition.path) as file:
            for row in self._records(file, partition.start, partition.end):
                rows.append(row)
                size += len(row["payload"] or b"") + 200
                if size > 8 << 20:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = [(n, pa.binary() if n == "payload" else pa.int64() if n == "payload_bytes" else pa.string()) for n in [*_FIELDS, "payload"]]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in kinds], names=[n for n, _ in kinds])

    def _records(self, file, start: int, end: int):
        at, whole = self._first(file, start) if start else 0, file.size()
        while at < end and at < whole:
            head, length = self._open(file, at)
            columns, body, size = head
            keep = all(columns[k] in v for k, v in self.wanted.items())
            take = keep and self.payload and size > 0
            if take or length is None:
                raw, used = self._inflate(file, at)
                length = length or used
            if keep:
                columns["payload"] = None
                if take:
                    block = raw[body : body + size]
                    http = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -1  # resource and metadata records have none
                    columns["payload"] = block[http + 4 :] if http >= 0 else block
                yield columns
            at += length

    def _open(self, file, at: int):
        """(parsed head, length of the member or None) at a member's first byte; inflates only as much as the head needs."""
        file.seek(at)
        first = file.read(512)
        if first[:3] != _MAGIC:
            raise ValueError(f"no gzip member at {at}")
        length = None
        if first[3] & 4 and first[12:14] == b"sl":
            length = struct.unpack("<I", first[16:20])[0]
        inflate, raw = zlib.decompressobj(31), b""
        while True:
            raw += inflate.decompress(first)
            if (head := parse_head(raw)) is not None:
                return head, length
            first = file.read(4096)
            if not first:
                raise ValueError(f"record at {at} has no whole header")

    @staticmethod
    def _inflate(file, at: int) -> tuple[bytes, int]:
        file.seek(at)
        inflate, parts, used = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            chunk = file.read(1 << 16)
            if not chunk:
                raise ValueError(f"record at {at} is cut off")
            parts.append(inflate.decompress(chunk))
            used += len(chunk)
        return b"".join(parts), used - len(inflate.unused_data)

    def _first(self, file, start: int) -> int:
        """The first member that begins at or after `start`."""
        at, rest = start, b""
        file.seek(start)
        while chunk := file.read(1 << 16):
            data = rest + chunk
            k = data.find(_MAGIC)
            while 0 <= k <= len(data) - 3:
                place = at - len(rest) + k
                try:
                    here = file.tell()
                    file.seek(place)
                    if zlib.decompressobj(31).decompress(file.read(512), 5) == b"WARC/":
                        return place
                except zlib.error:
                    pass
                finally:
                    file.seek(here)
                k = data.find(_MAGIC, k + 1)
            at += len(chunk)
            rest = data[-2:]
        return file.size()


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator):
        from pyspark import TaskContext

        fs, path = _filesystem(self.path)
        fs.create_dir(path, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        temporary, count = f"{path}/_{name}", 0
        with fs.open_output_stream(temporary, compression=None) as out:
            for row in iterator:
                out.write(pack(row.asDict()))
                count += 1
        return Written(temporary, f"{path}/{name}" if count else "")

    def commit(self, messages):
        fs, _ = _filesystem(self.path)
        for m in messages:
            if m is not None:
                fs.move(m.temporary, m.name) if m.name else fs.delete_file(m.temporary)

    def abort(self, messages):
        fs, _ = _filesystem(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.temporary)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "quillon_warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """pages(page_id, url, html) -> rows of SCHEMA. Of equal payloads of `least` bytes or more the one with the largest
    page_id is a response (all its rows, if repeated), the others revisit it. A null html is an empty payload.

    Only digests and ids are shuffled; payloads stay where they were read unless repeated payloads are too many to broadcast.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    seen = pages.select("page_id", "url", payload.alias("payload")).select("*", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    keys = seen.where(F.col("payload_bytes") >= least).select("payload_digest", "page_id")
    kept = keys.groupBy("payload_digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    out = seen.join(sized(kept), "payload_digest", "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return out.select(
        F.col("page_id").cast("string").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
        F.when(revisit, F.col("keeper").cast("string")).alias("refers_to"), "payload_digest", "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write(df: DataFrame, path: str) -> None:
    register(df.sparkSession)
    df.write.format("quillon_warc").option("path", path).mode("append").save()


def read(spark: SparkSession, path: str, payload: bool = True, split: int = 64 << 20) -> DataFrame:
    register(spark)
    return spark.read.format("quillon_warc").option("path", path).option("payload", str(payload).lower()).option("split", str(split)).load()


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages' archive to the shared folder, read it back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response are those of the payload that was read; a revisit, which stores none, has its headers'.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(records(pages), path)
    payload = F.coalesce(F.col("payload"), F.lit(b""))
    full = read(spark, path).where("record_type = 'response'").select("record_id", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"), "record_type", "refers_to")
    short = read(spark, path, payload=False).where("record_type = 'revisit'").select("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return full.union(short).select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )

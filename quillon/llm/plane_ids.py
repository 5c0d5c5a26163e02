"""Token ids in bit-plane shuffled files, and a PySpark Python data source over them, "quillon_ids".

A dataset is a folder of files with one index, `_index.json`, that lists them in order; a file that it does not list is
no part of it, so what a lost executor or a second attempt leaves is never read. A file is a run of blocks of BLOCK ids
and, at its end, a chunk index. The ids of a block are transposed into planes (option "planes"): "byte", plane k is byte k of
each id; "bit", each byte plane is transposed once more into its eight bits. Each plane is compressed by zstandard alone. A
block also has the planes of its documents' keys and lengths: of the documents that begin in it. The chunk index holds,
for each block, its place, how many ids and documents come before it, a checksum of its ids and the size of each plane.

Reading: partitions are runs of blocks (option "split", ids), planned from `_index.json` and the chunk indexes' sizes; a run owns
the documents that begin in its blocks and reads on only as far as its last document goes. Option "ids" = "false" leaves the
planes of the ids alone. Columns: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned
32-bit integers).

`write_ids` orders documents by doc_id, null first, over ranges of (doc_id, row number), so one doc_id on a third of all
rows is spread over many tasks; equal doc_ids come in the order of their row numbers. A null text is an empty one and has the end id
alone; repeated rows give repeated documents; an empty table gives an index without files. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quillon.llm.common import bounded_batches, discard, materialize, new_path

#: Ids of a block, and documents of one at most.
BLOCK, BLOCK_DOCS = 1 << 16, 1 << 18
#: Ids of a file; a task that gets more begins another.
FILE_IDS = 1 << 25
#: Distinct words and pieces a worker remembers, their length, and the characters of text split into them at a time.
CACHE, CACHE_CHARS, CHUNK = 600_000, 64, 1 << 20
LEVEL = 3
MAGIC = b"QPLANES1"
_TAIL = struct.Struct("<QII8s")  # where the chunk index begins, its length, its blocks


def planes(values: np.ndarray, bits: bool) -> list[bytes]:
    """The byte planes of unsigned integers, or the bit planes of each byte plane."""
    flat = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    if not bits:
        return [p.tobytes() for p in flat]
    return [np.packbits(b).tobytes() for p in flat for b in np.unpackbits(p.reshape(-1, 1), axis=1).T]


def joined(parts: list[bytes], count: int, kind: str, bits: bool) -> np.ndarray:
    """The integers whose planes these are."""
    width = np.dtype(kind).itemsize
    if bits:
        each = [np.unpackbits(np.frombuffer(p, np.uint8), count=count) for p in parts]
        flat = [np.packbits(np.stack(each[8 * k : 8 * k + 8], axis=1), axis=1).ravel() for k in range(width)]
    else:
        flat = [np.frombuffer(p, np.uint8) for p in parts]
    return np.stack(flat, axis=1).reshape(count, width).copy().view(kind).ravel() if count else np.zeros(0, kind)


class FileWriter:
    """Writes one file; `add` takes documents in order, `close` writes the rest and the chunk index."""

    def __init__(self, out, kind: str, bits: bool):
        self.out, self.kind, self.bits = out, kind, bits
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.at, self.ids, self.docs, self.blocks = 0, 0, 0, []  # bytes, ids and documents written
        self.pending: list[np.ndarray] = []  # ids not written yet
        self.size = 0
        self.starting: list[tuple[int | None, int, int]] = []  # documents not written yet: key, length, first id
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.starting.append((key, len(ids), self.ids + self.size))
        self.pending.append(ids)
        self.size += len(ids)
        if self.size >= BLOCK:
            waiting = np.concatenate(self.pending)
            whole = self.size - self.size % BLOCK
            for k in range(0, whole, BLOCK):
                self._block(waiting[k : k + BLOCK])
            self.pending, self.size = [waiting[whole:]], self.size - whole
        elif len(self.starting) >= BLOCK_DOCS:
            self._block(np.concatenate(self.pending))
            self.pending, self.size = [], 0

    def _block(self, ids: np.ndarray) -> None:
        end = self.ids + len(ids)
        cut = len(self.starting)
        while cut and (self.starting[cut - 1][2] > end or self.starting[cut - 1][2] == end and self.starting[cut - 1][1]):
            cut -= 1
        here, self.starting = self.starting[:cut], self.starting[cut:]
        keys = np.array([k or 0 for k, _, _ in here], "<i8")
        null = np.packbits(np.array([k is None for k, _, _ in here], bool)).tobytes()
        each = planes(ids.astype(self.kind), self.bits) + [null] + planes(keys, False) + planes(np.array([n for _, n, _ in here], "<u8"), False)
        packed = [self.pack.compress(p) for p in each]
        lead = here[0][2] - self.ids if here else 0
        self.blocks.append((self.at, self.ids, lead, len(ids), len(here), zlib.crc32(ids.astype("<u4").tobytes()), *map(len, packed)))
        self._put(b"".join(packed))
        self.ids, self.docs = end, self.docs + len(here)

    def close(self) -> None:
        if self.size or self.starting or not self.blocks:
            self._block(np.concatenate([*self.pending, np.zeros(0, self.kind)]))
        index = self.pack.compress(np.array(self.blocks, "<u8").tobytes())
        self._put(index + _TAIL.pack(self.at, len(index), len(self.blocks), MAGIC))


class File:
    """A file opened for reading."""

    def __init__(self, file, kind: str, bits: bool):
        self.file, self.kind, self.bits = file, kind, bits
        self.unpack = zstandard.ZstdDecompressor()
        file.seek(file.size() - _TAIL.size)
        begin, length, count, magic = _TAIL.unpack(file.read(_TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a file of token ids, or cut off")
        file.seek(begin)
        self.index = np.frombuffer(self.unpack.decompress(file.read(length)), "<u8").reshape(count, -1).astype(np.int64)
        self.n_planes = np.dtype(kind).itemsize * (8 if bits else 1)

    def _planes(self, block: int, first: int, last: int) -> list[bytes]:
        sizes = self.index[block, 6:]
        self.file.seek(int(self.index[block, 0] + sizes[:first].sum()))
        out = []
        for n in sizes[first:last].tolist():
            out.append(self.unpack.decompress(self.file.read(n)))
        return out

    def ids(self, block: int) -> np.ndarray:
        n, check = self.index[block, [3, 5]].tolist()
        found = joined(self._planes(block, 0, self.n_planes), n, self.kind, self.bits).astype("<u4")
        if zlib.crc32(found.tobytes()) != check:
            raise ValueError(f"block {block} is damaged")
        return found

    def documents(self, block: int) -> tuple[list[int | None], np.ndarray]:
        """(keys, lengths) of the documents that begin in a block."""
        n = int(self.index[block, 4])
        each = self._planes(block, self.n_planes, self.n_planes + 17)
        null = np.unpackbits(np.frombuffer(each[0], np.uint8), count=n)
        keys = joined(each[1:9], n, "<i8", False)
        return [None if z else k for z, k in zip(null.tolist(), keys.tolist(), strict=True)], joined(each[9:], n, "<u8", False).astype(np.int64)


@dataclass
class Run(InputPartition):
    path: str
    base: int
    first: int
    last: int


@dataclass
class Written(WriterCommitMessage):
    partition: int
    files: list


def _filesystem(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path else pafs.FileSystem.from_uri("file://" + os.path.abspath(path.removeprefix("file:")))


class IdsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", 1 << 23))
        self.wanted = str(options.get("ids", "true")).lower() == "true"
        fs, path = _filesystem(self.path)
        with fs.open_input_stream(f"{path}/_index.json") as f:
            self.index = json.loads(f.read())

    def partitions(self):
        out, base = [], 0
        step = max(1, self.split // BLOCK)
        for name, ids, _, blocks in self.index["files"]:
            out += [Run(name, base, k, min(k + step, blocks)) for k in range(0, blocks, step)]
            base += ids
        return out or [Run("", 0, 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        fs, path = _filesystem(self.path)
        with fs.open_input_file(f"{path}/{partition.path}") as raw:
            f = File(raw, self.index["kind"], self.index["planes"] == "bit")
            first, held = f.index[:, 1], {}
            for block in range(partition.first, partition.last):
                keys, lengths = f.documents(block)
                ends = int(first[block] + f.index[block, 2]) + np.cumsum(lengths)
                starts, k = ends - lengths, 0
                while k < len(keys):  # documents of a few million ids together, or one longer document
                    stop = k + max(1, int(np.searchsorted(ends[k:], starts[k] + (1 << 22), "right"))) if self.wanted else len(keys)
                    ids = [None] * (stop - k)
                    if self.wanted:
                        need = range(int(np.searchsorted(first, starts[k], "right")) - 1, int(np.searchsorted(first, ends[stop - 1], "left")))
                        held = {x: held[x] if x in held else f.ids(x) for x in need}
                        flat = b"".join(held[x].tobytes() for x in need)
                        cuts = 4 * (np.append(starts[k:stop], ends[stop - 1]) - (first[need[0]] if need else 0))
                        ids = [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                    yield self._batch(keys[k:stop], partition.base + starts[k:stop], lengths[k:stop], ids)
                    k = stop

    @staticmethod
    def _batch(keys, starts, lengths, ids) -> pa.RecordBatch:
        arrays = [pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids"])


class IdsWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.kind, self.bits = options["path"], options.get("kind", "<u4"), options.get("planes", "byte") == "bit"

    def write(self, iterator):
        from pyspark import TaskContext

        fs, path = _filesystem(self.path)
        fs.create_dir(path, recursive=True)
        files, writer, out = [], None, None
        part = TaskContext.get().partitionId()

        def end() -> None:
            writer.close()
            out.close()
            files.append((name, writer.ids, writer.docs, len(writer.blocks)))

        for batch in iterator:
            for key, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if writer is not None and writer.ids + writer.size >= FILE_IDS:
                    end()
                    writer = None
                if writer is None:
                    name = f"part-{part:06d}-{len(files):04d}-{uuid.uuid4().hex}.ids"
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    writer = FileWriter(out, self.kind, self.bits)
                writer.add(key, np.frombuffer(ids.as_buffer(), self.kind) if ids.is_valid else np.zeros(0, self.kind))
        if writer is not None:
            end()
        return Written(part, files)

    def commit(self, messages):
        fs, path = _filesystem(self.path)
        fs.create_dir(path, recursive=True)
        files = [f for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition) for f in m.files]
        with fs.open_output_stream(f"{path}/_index.json", compression=None) as out:
            out.write(json.dumps({"kind": self.kind, "planes": "bit" if self.bits else "byte", "files": files}).encode())

    def abort(self, messages):
        fs, path = _filesystem(self.path)
        for m in messages:
            for f in m.files if m is not None else []:
                fs.delete_file(f"{path}/{f[0]}")


class IdsDataSource(DataSource):
    @classmethod
    def name(cls):
        return "quillon_ids"

    def schema(self):
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema):
        return IdsReader(dict(self.options))

    def writer(self, schema, overwrite):
        return IdsWriter(dict(self.options))


#: How the word tokenizer splits a lower-cased text into pieces, as its file states it.
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of these characters and ASCII white space are normalised by lower-casing alone, and all their letters are in the second class.
_SIMPLE = re.compile("[ \t-\r!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch
_SIMPLE_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^ \t-\ra-z0-9\xdf-\xf6\xf8-\xff]+").findall


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it can be seen, else the next one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b if b in seen else next(others)) for b in range(256)]


class Encoder:
    """The ids of whole texts by a `tokenizers` file.

    A tokenizer that drops white space and splits by WORD_PIECES (as its file says; any other gets whole texts) encodes a text as
    the words between its ASCII white space, one after another. The pieces of simple words go to the library's BPE model directly,
    other words to the library as they are. Both repeat, so a worker keeps the ids of up to CACHE of them.
    """

    def __init__(self, path: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = max(self.tokenizer.get_vocab_size(with_added_tokens=True), (end_id or 0) + 1)
        self.kind = kind_of(size)
        self.end = b"" if end_id is None else np.array([end_id], self.kind).tobytes()
        said = json.loads(self.tokenizer.to_str())
        self.by_words = (
            [(n["type"], n.get("pattern")) for n in (said["normalizer"] or {}).get("normalizers", [])] == [("NFC", None), ("Replace", {"Regex": r"\s+"}), ("Lowercase", None)]
            and [(p["type"], p.get("pattern"), p.get("behavior"), p.get("invert"), p.get("use_regex"), p.get("add_prefix_space")) for p in (said["pre_tokenizer"] or {}).get("pretokenizers", [])]
            == [("Split", {"Regex": WORD_PIECES}, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)]
            and all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or set(t["content"]) & set(" \t\n\r\x0b\x0c")) for t in said["added_tokens"])
        )
        self.special = [t["content"] for t in said["added_tokens"]]
        self.letters = {i: c for i, c in enumerate(byte_letters())}
        self.known: dict[str | bytes, bytes] = {}  # pieces are str, whole words bytes

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _simple(self, text: str) -> bool:
        return _SIMPLE(text) is not None and not any(x in text for x in self.special)

    def _split(self, text: str) -> list[str | bytes]:
        if self._simple(text):
            return _SIMPLE_PIECES(text.lower())
        parts: list[str | bytes] = []
        for word in text.encode().split():
            plain = word.decode()
            parts += _SIMPLE_PIECES(plain.lower()) if self._simple(plain) else (word,)
        return parts

    def _learn(self, parts: set[str | bytes]) -> None:
        words, model, letters = [p for p in parts if isinstance(p, bytes)], self.tokenizer.model.tokenize, self.letters
        self.known.update(zip(words, self._library([w.decode() for w in words]), strict=True))
        for p in parts:
            if isinstance(p, str):
                ids = [t.id for t in model(p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(letters))]
                self.known[p] = np.array(ids, self.kind).tobytes()

    def _run(self, texts: list[str]) -> list[bytes]:
        each = [self._split(t) for t in texts]
        need = set().union(*each)
        if len(new := need - self.known.keys()) + len(self.known) > CACHE:
            self.known, new = {}, need
        self._learn(new)
        get = self.known.__getitem__
        out = [b"".join(map(get, parts)) for parts in each]
        for p in new:
            if len(p) > CACHE_CHARS:
                del self.known[p]
        return out

    def texts(self, texts) -> list[bytes]:
        """Texts are taken some CHUNK characters at a time; a longer one is cut at spaces."""
        if not self.by_words:
            return [x + self.end for x in self._library([t or "" for t in texts])]
        found: list[list[bytes]] = []
        waiting, size = [], 0
        for k, text in enumerate(texts):
            found.append([])
            text, at = text or "", 0
            while at < len(text):
                stop = len(text) if len(text) - at <= CHUNK else text.find(" ", at + CHUNK)
                stop = len(text) if stop < 0 else stop
                waiting.append((k, text[at:stop]))
                size, at = size + stop - at, stop
                if size >= CHUNK:
                    for (i, _), x in zip(waiting, self._run([t for _, t in waiting]), strict=True):
                        found[i].append(x)
                    waiting, size = [], 0
        for (i, _), x in zip(waiting, self._run([t for _, t in waiting]), strict=True):
            found[i].append(x)
        return [b"".join([*x, self.end]) for x in found]


def kind_of(size: int) -> str:
    """The narrowest unsigned integers that hold ids below `size`."""
    return "<u2" if size <= 1 << 16 else "<u4"


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int | None) -> Encoder:
    return Encoder(path, end_id)


def encoded(documents: DataFrame, path: str, end_id: int | None = None, key: str = "doc_id") -> DataFrame:
    """documents(key, text) -> doc_id, ids: little-endian unsigned integers, as wide as the vocabulary needs."""
    bounded_batches(documents.sparkSession)

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(encoder(path, end_id).texts(texts), dtype=object)

    return documents.select(F.col(key).cast("long").alias("doc_id"), run("text").alias("ids"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(IdsDataSource)


def write_ids(df: DataFrame, path: str, kind: str = "<u4", planes: str = "byte") -> None:
    """df(doc_id, ids as integers of `kind`) -> a dataset at `path`, documents in ascending order of doc_id.

    df is written once first: its row numbers must not change when an executor is lost, and its ids are counted for the number
    of ranges. Only ids are shuffled, once.
    """
    spark = df.sparkSession
    register(spark)
    kept = materialize(df.select("doc_id", "ids", F.monotonically_increasing_id().alias("row")), "ids")
    total = kept.agg(F.sum(F.octet_length("ids").cast("long"))).first()[0] or 0
    total //= np.dtype(kind).itemsize
    cores = spark.sparkContext.defaultParallelism
    parts = max(1, -(-total // FILE_IDS), min(2 * cores, total >> 18))
    bounded_batches(spark)
    ordered = kept.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row")
    ordered.select("doc_id", "ids").write.format("quillon_ids").option("path", path).option("kind", kind).option("planes", planes).mode("append").save()
    discard(kept)


def read_ids(spark: SparkSession, path: str, ids: bool = True, split: int = 1 << 23) -> DataFrame:
    """doc_id, start, n_tokens, ids of a dataset; ids is null, and its planes are not read, where not wanted."""
    register(spark)
    return spark.read.format("quillon_ids").option("path", path).option("ids", str(ids).lower()).option("split", str(split)).load()


def token_files(documents: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Encode, write, read back: doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    spark = documents.sparkSession
    at = new_path(spark, "token-ids")
    write_ids(encoded(documents, path, end_id), at, vocabulary_kind(path, end_id))
    return read_ids(spark, at).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def vocabulary_kind(path: str, end_id: int | None = None) -> str:
    return encoder(path, end_id).kind

"""Archives by member, a PySpark Python data source, "quillon_members".

Reading. A partition is some small archives, or a run of members of a large one: an archive larger than `split` bytes is opened where the
read is planned, and only its table of contents is read (a zip's central directory, a tar's chain of headers). A task reads its members one by one,
so it holds one member, not an archive. A compressed tar has no places to begin at: it is one task's, read as a stream.
Rows are those of `archives.SCHEMA`; text files are told by their suffix (option "suffixes"), and an archive that cannot be read, or can be only
in part, has a row with `problem`.

Writing (rows of project, path, text). One zip for each project, its members written one by one as they come; a task writes under a
temporary name, and the commit renames what the attempts that counted have written. `write_zips` brings the rows in order.
"""

from __future__ import annotations

import gzip
import os
import tarfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "archive string, path string, text string, problem string"
SUFFIXES = (".tex", ".bib", ".md", ".txt", ".bbl", ".sty", ".cls")
#: Bytes of archives, or of members in an archive, of a partition; bytes of text of a batch of rows.
SPLIT, BATCH = 32 << 20, 4 << 20


def filesystem(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path else pafs.FileSystem.from_uri("file://" + os.path.abspath(path.removeprefix("file:")))


@dataclass
class Members(InputPartition):
    """Archives as wholes, or members first..last - 1 of one in the order of its contents."""

    paths: list[str]
    first: int = 0
    last: int | None = None


def kind_of(head: bytes) -> str:
    if head[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return "zip"
    if head[:2] == b"\x1f\x8b":
        return "gz"
    return "tar" if head[257:262] == b"ustar" else "file"


def sizes_of(file, kind: str) -> list[int]:
    """Bytes of the members of a zip or tar, from its table of contents alone."""
    if kind == "zip":
        with zipfile.ZipFile(file) as z:
            return [i.compress_size for i in z.infolist()]
    with tarfile.open(fileobj=file, mode="r:") as t:
        return [m.size for m in t]


def read_members(file, name: str, suffixes: tuple[str, ...], first: int = 0, last: int | None = None) -> Iterator[tuple[str, bytes]]:
    """(path, content) of an archive's text files among its members first..last - 1."""
    head = file.read(512)
    file.seek(0)
    kind = kind_of(head)
    if kind == "zip":
        with zipfile.ZipFile(file) as z:
            for i in z.infolist()[first:last]:
                if not i.is_dir() and i.filename.lower().endswith(suffixes):
                    yield i.filename, z.read(i)
        return
    bare = name.rpartition("/")[2]
    if kind == "gz":
        inner = gzip.GzipFile(fileobj=file)
        head = inner.read(512)
        file.seek(0)
        if kind_of(head) != "tar":
            if bare.removesuffix(".gz").lower().endswith(suffixes):
                yield bare.removesuffix(".gz"), gzip.GzipFile(fileobj=file).read()
            return
    if kind == "file":
        if bare.lower().endswith(suffixes):
            yield bare, file.read()
        return
    with tarfile.open(fileobj=file, mode="r|gz" if kind == "gz" else "r:") as t:
        for k, m in enumerate(t):
            if last is not None and k >= last:
                return
            if k >= first and m.isfile() and m.name.lower().endswith(suffixes):
                yield m.name, t.extractfile(m).read()


class MembersReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.suffixes = tuple(options["suffixes"].split(",")) if options.get("suffixes") else SUFFIXES

    def partitions(self):
        fs, path = filesystem(self.path)
        found = fs.get_file_info(path)
        files = [found] if found.type == pafs.FileType.File else [x for x in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if x.type == pafs.FileType.File]
        files = sorted((x for x in files if not x.base_name.startswith(("_", "."))), key=lambda x: x.path)
        out, small, size = [], [], 0
        for x in files:
            runs = self._runs(fs, x.path) if x.size > self.split else None
            if runs:
                out += [Members([x.path], a, b) for a, b in runs]
                continue
            if small and size + x.size > self.split:
                out.append(Members(small))
                small, size = [], 0
            small.append(x.path)
            size += x.size
        if small:
            out.append(Members(small))
        return out or [Members([])]

    def _runs(self, fs, path: str) -> list[tuple[int, int]] | None:
        """Runs of members of about `split` bytes; None where an archive has to be read as one, or cannot be."""
        try:
            with fs.open_input_file(path) as file:
                head = file.read(512)
                file.seek(0)
                if kind_of(head) not in ("zip", "tar"):
                    return None
                sizes = sizes_of(file, kind_of(head))
        except Exception:  # told by the row of the task that reads it
            return None
        runs, begin, size = [], 0, 0
        for k, n in enumerate(sizes):
            if size and size + n > self.split:
                runs.append((begin, k))
                begin, size = k, 0
            size += n
        return [*runs, (begin, len(sizes))]

    def read(self, partition):
        fs, _ = filesystem(self.path)
        scheme = self.path.partition("://")[0] if "://" in self.path else "file"
        rows, size = [], 0
        for path in partition.paths:
            name = f"{scheme}:{path}" if scheme == "file" else f"{scheme}://{path}"
            try:
                with fs.open_input_file(path) as file:
                    for inner, raw in read_members(file, path, self.suffixes, partition.first, partition.last):
                        rows.append((name, inner, raw.decode("utf-8", "replace"), None))
                        size += len(raw)
                        if size > BATCH:
                            yield self._batch(rows)
                            rows, size = [], 0
            except Exception as e:  # any damage of the container
                rows.append((name, None, None, type(e).__name__))
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["archive", "path", "text", "problem"])


@dataclass
class Zips(WriterCommitMessage):
    made: list[tuple[str, str]]


class ZipWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator):
        fs, path = filesystem(self.path)
        fs.create_dir(path, recursive=True)
        made, now, out, z = [], None, None, None

        def end() -> None:
            z.close()
            out.close()

        for batch in iterator:
            for project, name, text in zip(*(batch.column(c).to_pylist() for c in ("project", "path", "text")), strict=True):
                if project != now:
                    if z is not None:
                        end()
                    now, temporary = project, f"{path}/_{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temporary, compression=None)
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                    made.append((temporary, f"{path}/{quote(project, safe='')}.zip"))
                z.writestr(zipfile.ZipInfo(name), (text or "").encode("utf-8", "replace"), zipfile.ZIP_DEFLATED)
        if z is not None:
            end()
        return Zips(made)

    def commit(self, messages):
        fs, _ = filesystem(self.path)
        for m in messages:
            for temporary, name in m.made if m is not None else []:
                fs.move(temporary, name)

    def abort(self, messages):
        fs, _ = filesystem(self.path)
        for m in messages:
            for temporary, _ in m.made if m is not None else []:
                fs.delete_file(temporary)


class MembersDataSource(DataSource):
    @classmethod
    def name(cls):
        return "quillon_members"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return MembersReader(dict(self.options))

    def writer(self, schema, overwrite):
        return ZipWriter(dict(self.options))


def read_archives(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES, split: int = SPLIT) -> DataFrame:
    """Rows of SCHEMA of the text files of all archives under a path."""
    spark.dataSource.register(MembersDataSource)
    return spark.read.format("quillon_members").option("path", path).option("suffixes", ",".join(suffixes)).option("split", str(split)).load()


def write_zips(files: DataFrame, path: str) -> None:
    """files(project, path, text) -> one zip for each project under `path`, members in the order of their paths. Null texts are empty, rows without a
    project or a path are left out, of a path that repeats the least text is taken."""
    files.sparkSession.dataSource.register(MembersDataSource)
    once = files.where("project is not null and path is not null").groupBy(F.col("project").cast("string").alias("project"), "path").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    ordered = once.repartition("project").sortWithinPartitions("project", "path").select("project", "path", "text")
    ordered.write.format("quillon_members").option("path", path).mode("append").save()

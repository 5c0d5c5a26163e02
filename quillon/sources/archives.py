"""Archives of text files as rows: those in a column unpacked in tasks, those in files read by `members`."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources import members
from quillon.sources.members import SCHEMA  # noqa: F401


def unpack(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    """(path, content) of the files inside; the container is told by its first bytes."""
    if data[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i in z.infolist():
                if not i.is_dir():
                    yield i.filename, z.read(i)
        return
    inner = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    if inner[257:262] == b"ustar":
        with tarfile.open(fileobj=io.BytesIO(inner)) as t:
            for m in t:
                if m.isfile():
                    yield m.name, t.extractfile(m).read()
    elif inner is not data:
        yield name.rpartition("/")[2].removesuffix(".gz"), inner
    else:
        yield name.rpartition("/")[2], data


def read_archives(spark: SparkSession, path: str, suffixes: tuple[str, ...] = members.SUFFIXES) -> DataFrame:
    """Rows of SCHEMA: text files of all archives under a path, read by member. A damaged archive is one row with `problem` set."""
    return members.read_archives(spark, path, suffixes)


def zipped(files: DataFrame) -> DataFrame:
    """files(project, path, text) -> (project, archive, crc): a zip of each project's files in the order of their paths, the same
    bytes whenever it is made, and its CRC-32. Null texts are empty; of a path that repeats the least text is taken."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        box = io.BytesIO()
        with zipfile.ZipFile(box, "w", zipfile.ZIP_DEFLATED) as z:
            for path, text in sorted(zip(group["path"], group["text"], strict=True)):
                z.writestr(zipfile.ZipInfo(path), text.encode("utf-8", "replace"), zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"project": [group["project"].iloc[0]], "archive": [box.getvalue()], "crc": [zlib.crc32(box.getvalue())]})

    once = files.where("path is not null").groupBy("project", "path").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    kind = files.schema["project"].dataType.simpleString()
    return once.groupBy("project").applyInPandas(run, f"project {kind}, archive binary, crc long")


def unzipped(archives: DataFrame) -> DataFrame:
    """archives(project, archive) -> (project, path, text) of the files in them."""

    @F.pandas_udf("array<struct<path string, text string>>")
    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda x: [] if x is None else [{"path": n, "text": b.decode("utf-8", "replace")} for n, b in unpack("", x)])

    return archives.select("project", F.explode(run("archive")).alias("f")).select("project", "f.path", "f.text")


def write_text(df: DataFrame, path: str) -> None:
    """One text file per row's partition; the counterpart of spark.read.text(wholetext=True)."""
    df.select(F.col("text").alias("value")).write.text(path)

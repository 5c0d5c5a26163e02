"""Helpers shared by the training-data operators: durable intermediate tables, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting to remove a query's shuffle files when it ends, rather than when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A side with at most this many narrow rows may be broadcast; beyond it the plain shuffle join is used.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where unset, one is set for a local master; elsewhere that is
    an error, for a machine-local folder would be lost to the other executors."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and any executor can reread it.

    Its shuffle files go when it is written: nothing reads them again, and those of several tables would add up on disk.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that materialize() has written, once whatever reads them has been written itself."""
    for df in tables:
        hadoop = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """Arrow batches of at most `rows` rows and about `size` bytes from now on: texts are long, and a worker holds a batch whole.

    These are settings of the session, as plans are made when they run; smaller bounds of the user's own stay.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = str(spark.conf.get(key)).lower().removesuffix("b")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it holds at most `limit` rows (counted), else df as it is: a shuffle join then."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Document history as a stream: idempotent snapshots, retention, debounced saves and near-duplicate suppression."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators.relational import newest


#: Texts of more characters are not uploaded.
SNAPSHOT = 200_000


def snapshots(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """One row for each (user_id, text_hash): repeats inside the watermark are dropped, state older than it is forgotten.

    events(user_id, ts, text); ts is cast to TIMESTAMP, as watermarks need. Blank, null and huge texts are no snapshots.
    """
    good = events.where(f"text is not null and trim(text) <> '' and length(text) <= {SNAPSHOT}").withColumn("ts", F.col("ts").cast("timestamp"))
    return good.withColumn("text_hash", F.sha2("text", 256)).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["user_id", "text_hash"])


def debounced(events: DataFrame, gap: str = "3 seconds", lateness: str = "1 minute") -> DataFrame:
    """Saves of a user closer than `gap` are one session; its last text is what is kept."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("saves"), F.max_by("text", "ts").alias("text")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "saves", "text")


def change_size(a: str, b: str) -> int:
    """Length of the changed span between two texts: the longer one less common prefix and suffix."""
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
    return max(len(a), len(b)) - head - tail


#: Texts longer than this are no snapshots; so many of the newest of a user are remembered.
HUGE, REMEMBERED = 150_000, 40


def worth_keeping(state: list | None, title: str, reason: str, text: str | None, least: int = 24) -> tuple[list, bool]:
    """(new state, whether to keep) of the next text of a user; state is the newest kept ones as (title, text), newest first.

    Blank and huge texts are never kept, nor is one equal to the last of its title (of any title, where its own has none), nor
    one of an idle pause that differs from it by fewer than `least` characters.
    """
    state = state or []
    if text is None or not text.strip() or len(text) > HUGE:
        return state, False
    last = next((t for name, t in state if name == title), state[0][1] if state else None)
    if last is not None and (last == text or reason == "idle" and change_size(last, text) < least):
        return state, False
    return [(title, text), *state][:REMEMBERED], True


def suppressed(events: DataFrame, least: int = 24) -> DataFrame:
    """events(user_id, ts, title, reason, text) as a stream -> those worth keeping, by state per user."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        titles, texts = state.get if state.exists else ([], [])
        kept = list(zip(titles, texts, strict=True))
        for frame in frames:
            frame = frame.sort_values("ts", kind="stable")
            rows = []
            for i, (title, reason, text) in enumerate(zip(frame["title"], frame["reason"], frame["text"], strict=True)):
                kept, taken = worth_keeping(kept, title, reason, text, least)
                if taken:
                    rows.append(i)
            yield frame.iloc[rows][["user_id", "ts", "title", "reason", "text"]]
        if kept:
            state.update(([t for t, _ in kept], [x for _, x in kept]))

    e = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "title", "reason", "text")
    out = "user_id long, ts timestamp, title string, reason string, text string"
    return e.groupBy("user_id").applyInPandasWithState(run, out, "titles array<string>, texts array<string>", "append", GroupStateTimeout.NoTimeout)


def retain(path: str, key: str = "user_id", n: int = 500, buckets: int = 64):
    """A foreachBatch sink that keeps each key's newest n snapshots, the same after a replayed batch.

    The table is cut into buckets by hash of the key. A batch rewrites the buckets that it touches into a folder of its
    number and leaves the others; of each bucket the greatest finished number counts. Of equal snapshots the earliest stays.
    """

    def sink(batch: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        new = batch.withColumn("bucket", bucket)
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most `buckets` numbers
        before = latest(batch.sparkSession, path, number, touched)
        whole = new if before is None else before.withColumn("bucket", bucket).unionByName(new)
        rest = [c for c in whole.columns if c not in (key, "text_hash", "bucket")]
        first = whole.groupBy("bucket", key, "text_hash").agg(F.min_by(F.struct(*rest), "ts").alias("s")).select("bucket", key, "text_hash", "s.*")
        kept = newest(first, key, [F.desc("ts"), F.desc("text_hash")], n).select("bucket", *batch.columns)
        kept.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")

    return sink


def latest(spark, path: str, below: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The table as of the last finished batch (before number `below`), or some of its buckets; None where it has no rows."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return None
    at = {}
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        if not name.startswith("batch=") or not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")):
            continue
        number = int(name.split("=")[1])
        for b in fs.listStatus(s.getPath()) if below is None or number < below else ():
            part = b.getPath().getName()
            if part.startswith("bucket=") and (buckets is None or int(part.split("=")[1]) in buckets):
                at[part] = max(number, at.get(part, -1))
    return spark.read.parquet(*[f"{path}/batch={number}/{part}" for part, number in at.items()]) if at else None

import gzip
import io
import random
import tarfile
import zipfile

from pyspark.sql import functions as F

from quillon.operators import timing
from quillon.sources import archives
from quillon.streaming import sync


def stream_of(spark, rows, path):
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, text string").coalesce(1).write.parquet(path)
    return spark.readStream.schema("user_id long, ts timestamp_ntz, text string").parquet(path)


def rows():
    import datetime as d

    at = lambda s: d.datetime(2024, 1, 1) + d.timedelta(seconds=s)
    return [(1, at(0), "alpha"), (1, at(1), "alpha"), (1, at(2), "beta"), (1, at(60), "alpha beta gamma delta epsilon zeta"), (2, at(5), "alpha"), (2, at(6), " "), (2, at(7), None)]


def test_snapshots_once_and_retention(spark, tmp_path):
    s = sync.snapshots(stream_of(spark, rows(), str(tmp_path / "in")))
    q = s.writeStream.foreachBatch(sync.retain(f"file://{tmp_path}/out", n=2)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.user_id, r.text) for r in sync.latest(spark, f"file://{tmp_path}/out").collect())
    assert got == [(1, "alpha beta gamma delta epsilon zeta"), (1, "beta"), (2, "alpha")]


def test_retention_rewrites_touched_buckets_and_keeps_the_earliest(spark, tmp_path):
    import datetime as d

    at = lambda s: d.datetime(2024, 1, 1) + d.timedelta(seconds=s)
    path, sink = f"file://{tmp_path}/out", sync.retain(f"file://{tmp_path}/out", n=2, buckets=4)
    table = lambda x: spark.createDataFrame(x, "user_id long, ts timestamp, text string, text_hash string")
    sink(table([(u, at(u), f"t{u}", f"h{u}") for u in range(6)] + [(0, at(9), "later", "h0")]), 0)
    for _ in range(2):  # a replayed batch gives the same
        sink(table([(0, at(20), "x", "hx"), (0, at(30), "y", "hy")]), 1)
        got = sorted((r.user_id, r.text, r.ts.second) for r in sync.latest(spark, path).collect())
        assert got == [(0, "x", 20), (0, "y", 30)] + [(u, f"t{u}", u) for u in range(1, 6)]


def plain_kept(rows):
    """rows (title, reason, text) of one user in order -> which are kept, the plain way."""
    kept, out = [], []
    for title, reason, text in rows:
        take = text is not None and text.strip() != "" and len(text) <= 150_000
        own = [t for name, t in kept if name == title] or [t for _, t in kept]
        if take and own:
            old, i, j = own[-1], 0, 0
            while i < min(len(old), len(text)) and old[i] == text[i]:
                i += 1
            while j < min(len(old), len(text)) - i and old[-1 - j] == text[-1 - j]:
                j += 1
            take = old != text and not (reason == "idle" and max(len(old), len(text)) - i - j < 24)
        out.append(take)
        if take:
            kept = [*kept, (title, text)][-40:]
    return out


def snapshots_of(seed):
    r = random.Random(seed)
    text = lambda: "".join(r.choice("ab ") for _ in range(r.choice([0, 3, 30, 60])))
    rows = []
    for user in range(6):
        last = "x" * 40
        for i in range(80):
            kind = r.randrange(5)
            last = last[:10] + text() + last[12:60] if kind < 2 else last if kind == 2 else text()
            rows.append((user, i, r.choice(["a", "b", "c"]), r.choice(["idle", "copy", "replace"]), r.choice([last, last, last, None, " \n"]) if i % 30 else "y" * 150_001))
    return rows


def test_snapshots_kept_equal_a_plain_version(spark, tmp_path):
    data = snapshots_of(3)
    want = sorted((u, i) for user in range(6) for (u, i, *_), keep in zip([x for x in data if x[0] == user], plain_kept([x[2:] for x in data if x[0] == user]), strict=True) if keep)
    df = spark.createDataFrame(data, "user_id long, seq long, title string, reason string, text string")
    got = timing.kept_snapshots(df, "user_id", "seq", "user_id long, seq long, title string, reason string, text string")
    assert sorted((r.user_id, r.seq) for r in got.collect()) == want and 50 < len(want) < 400

    timed = df.withColumn("ts", F.timestamp_seconds("seq")).drop("seq")
    timed.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = sync.suppressed(spark.readStream.schema(timed.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("kept").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.user_id, int(r.ts.timestamp())) for r in spark.table("kept").collect()) == want


def test_state_crosses_arrow_batches(spark):
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame([(k, i, t) for k in range(3) for i, t in enumerate([0, 4, 9, 10, 11, 20, 29, 30, 41])], "k long, i long, at long").withColumn("ts", F.timestamp_seconds("at").cast("timestamp_ntz"))
        got = timing.rate_limited(df, "k", "ts", "i", 10, "k long, i long, ts timestamp_ntz")
        assert sorted((r.k, r.i) for r in got.collect()) == [(k, i) for k in range(3) for i in (0, 3, 5, 7, 8)]
        assert timing.rate_limited(df.limit(0), "k", "ts", "i", 10, "k long, i long, ts timestamp_ntz").collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_debounce_in_batch(spark):
    df = spark.createDataFrame(rows(), "user_id long, ts timestamp_ntz, text string")
    got = sorted((r.user_id, r.saves, r.text) for r in sync.debounced(df).collect())
    assert got == [(1, 1, "alpha beta gamma delta epsilon zeta"), (1, 3, "beta"), (2, 3, None)]


def test_change_size():
    assert [sync.change_size(*x) for x in (("", ""), ("abc", "abc"), ("abc", "aXc"), ("abc", "abXYc"), ("aa", "aaa"))] == [0, 0, 1, 2, 1]


def test_archives(spark, tmp_path):
    box = io.BytesIO()
    with tarfile.open(fileobj=box, mode="w:gz") as t:
        info = tarfile.TarInfo("a/main.tex")
        info.size = 5
        t.addfile(info, io.BytesIO(b"hello"))
    (tmp_path / "one.tar.gz").write_bytes(box.getvalue())
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("r.bib", "@a{b,}")
        z.writestr("x.png", "no text")
    (tmp_path / "three.tex.gz").write_bytes(gzip.compress("é".encode()))
    (tmp_path / "bad.zip").write_bytes(b"PK\x03\x04broken")
    got = archives.read_archives(spark, str(tmp_path)).select("path", "text", F.col("problem").isNotNull().alias("bad"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([("a/main.tex", "hello", False), ("r.bib", "@a{b,}", False), ("three.tex", "é", False), (None, None, True)], key=str)

import datetime as d
import io
import os
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.operators import timing
from quillon.sources import archives, members
from quillon.streaming import uploads

START = d.datetime(2024, 1, 1)


def at(s):
    return START + d.timedelta(seconds=s)


def stream(spark, path, schema, *files):
    """A stream that takes one file a trigger, in this order."""
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/f{k}")
        (name,) = [x for x in os.listdir(f"{path}/f{k}") if x.endswith(".parquet")]
        os.makedirs(f"{path}/all", exist_ok=True)
        os.rename(f"{path}/f{k}/{name}", f"{path}/all/{k:03d}.parquet")
        os.utime(f"{path}/all/{k:03d}.parquet", (k + 1, k + 1))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/all")


def run(df, path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return q.sparkSession.table(name).collect() if hasattr(q, "sparkSession") else df.sparkSession.table(name).collect()


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, was)


def test_waits():
    assert [uploads.wait_after(k) for k in (1, 2, 3, 8, 9, 99)] == [2, 4, 8, 256, 300, 300]


def test_upload_queue_over_time(spark, tmp_path, rocks):
    schema = "user_id long, ts timestamp, kind string, id string, text_hash string"
    tick = lambda s: (9, at(s), "tick", None, None)
    files = [
        [(1, at(0), "add", "a", "A"), (1, at(0), "add", "a", "A"), (1, at(1), "add", None, "N"), (2, at(0), "add", "z", "Z"), tick(1)],  # A goes out
        [(1, at(2), "add", "b", "B"), (1, at(3), "failed", None, None), (2, at(3), "done", None, None), tick(4)],  # waits until 5
        [tick(20)],  # the watermark passes 5 with the next one
        [tick(40)],
        [(1, at(41), "done", None, None), (1, at(42), "add", "c", "B"), (1, at(43), "done", None, None), tick(60)],
        [tick(80)],
    ]
    got = run(uploads.upload_attempts(stream(spark, str(tmp_path), schema, *files)), str(tmp_path), "attempts")
    rows = sorted((r.user_id, int((r.at - START).total_seconds()), r.attempt, r.place, r.id) for r in got)
    assert rows == [(1, 0, 1, 1, "a"), (1, 5, 2, 1, "a"), (1, 5, 2, 2, "b"), (1, 42, 1, 1, "c"), (2, 0, 1, 1, "z")]


def test_upload_queue_is_bounded(spark, tmp_path, rocks):
    schema = "user_id long, ts timestamp, kind string, id string, text_hash string"
    many = [(1, at(0), "add", "x", "X"), *[(1, at(1 + k), "add", f"i{k:03d}", f"h{k}") for k in range(260)], (1, at(300), "done", None, None)]
    got = run(uploads.upload_attempts(stream(spark, str(tmp_path), schema, many)), str(tmp_path), "bounded")
    second = sorted((r.place, r.id) for r in got if int((r.at - START).total_seconds()) == 300)
    assert second == [(k + 1, f"i{60 + k:03d}") for k in range(25)]  # the newest 200 stayed, of them the oldest 25


def test_pairs_of_streams(spark, tmp_path):
    rnd = random.Random(2)
    left = [(k, rnd.randrange(3), at(rnd.randrange(60))) for k in range(60)]
    right = [(rnd.randrange(3), at(rnd.randrange(60)), f"v{k:02d}") for k in range(40)]
    schemas = "id long, user_id long, ts timestamp", "user_id long, ts timestamp, value string"
    end = [(999, 99, at(500))], [(99, at(500), "end")]
    parts = lambda rows, time: [[r for r in rows if lo <= (r[time] - START).total_seconds() < lo + 20] for lo in (0, 20, 40)]
    late = [(998, 0, at(3))]  # long after the watermark has passed it
    ls = stream(spark, f"{tmp_path}/l", schemas[0], *parts(left, 2), end[0], late, [(997, 99, at(900))])
    rs = stream(spark, f"{tmp_path}/r", schemas[1], *parts(right, 1), end[1], [(0, at(2), "late")], [(99, at(900), "end")])
    got = {r.id: r.value for r in run(uploads.paired_stream(ls, rs, "user_id", "ts", "value"), str(tmp_path), "pairs") if r.id < 900 or r.id == 998}
    want = {}
    for i, user, t in left:
        near = [(s, v) for u, s, v in right if u == user and s <= t and (t - s).total_seconds() <= 4]
        want[i] = max(near)[1] if near else None
    assert got == want
    batch = timing.paired(spark.createDataFrame(left, schemas[0]), spark.createDataFrame(right, schemas[1]), "user_id", "ts", "value")
    assert {r.id for r in batch.collect() if r.value is None} == {i for i, v in want.items() if v is None}


def make_tar(path, files, mode="w"):
    with tarfile.open(path, mode) as t:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


FILES = [(f"s/{k:02d}.tex", os.urandom(30 * (k + 1)).hex().encode()) for k in range(20)] + [("fig.png", b"no"), ("é.md", "ü".encode())]


@pytest.mark.parametrize("split", [1, 700, 1 << 25])
def test_members_of_archives(spark, tmp_path, split):
    make_tar(tmp_path / "a.tar", FILES)
    make_tar(tmp_path / "b.tar.gz", FILES, "w:gz")
    with zipfile.ZipFile(tmp_path / "c.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in FILES:
            z.writestr(name, data)
        z.writestr("dir/", "")
    (tmp_path / "bad.zip").write_bytes(b"PK\x03\x04" + b"x" * 2000)
    (tmp_path / "plain.txt").write_bytes(b"text")
    with open(tmp_path / "b.tar.gz", "rb") as f:
        (tmp_path / "cut.tar.gz").write_bytes(f.read()[:-400])
    df = members.read_archives(spark, str(tmp_path), split=split)
    got = {}
    for r in df.collect():
        got.setdefault(r.archive.rpartition("/")[2], []).append((r.path, r.text) if r.problem is None else (None, None))
    want = sorted((n, x.decode()) for n, x in FILES if not n.endswith(".png"))
    assert all(sorted(got[a]) == want for a in ("a.tar", "b.tar.gz", "c.zip"))
    assert got["plain.txt"] == [("plain.txt", "text")] and got["bad.zip"] == [(None, None)]
    assert got["cut.tar.gz"][-1] == (None, None) and set(got["cut.tar.gz"][:-1]) <= set(want)
    if split == 700:
        runs = [p for p in members.MembersReader({"path": str(tmp_path), "split": str(split)}).partitions() if p.paths[0].endswith("c.zip")]
        assert len(runs) > 3 and [p.first for p in runs[1:]] == [p.last for p in runs[:-1]]


def test_no_archives(spark, tmp_path):
    assert members.read_archives(spark, str(tmp_path)).collect() == []


def test_zips_written_and_read_back(spark, tmp_path):
    rows = [("p/1", "b.tex", "two"), ("p/1", "a.tex", "one"), ("p/1", "a.tex", "zzz"), ("q", "x.md", None), (None, "y.md", "no"), ("q", None, "no")]
    members.write_zips(spark.createDataFrame([(*r, 1) for r in rows], "project string, path string, text string, extra int").repartition(3), f"file://{tmp_path}/z")
    assert sorted(os.listdir(tmp_path / "z")) == ["p%2F1.zip", "q.zip"]
    with zipfile.ZipFile(tmp_path / "z" / "p%2F1.zip") as z:
        assert [(i.filename, z.read(i)) for i in z.infolist()] == [("a.tex", b"one"), ("b.tex", b"two")]
    got = archives.read_archives(spark, str(tmp_path / "z")).select("path", "text").collect()
    assert sorted(map(tuple, got)) == [("a.tex", "one"), ("b.tex", "two"), ("x.md", "")]
    assert spark.read.format("binaryFile").load(f"{tmp_path}/z").select(F.count("*")).collect()[0][0] == 2

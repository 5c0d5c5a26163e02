import gzip
import hashlib

from quillon.llm import warc as W


def pages():
    big, other = "<p>é" * 400, "y" * 1000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (3, "u", other), (4, "u", other[:-1]), (5, "u", other[:-1]), (6, "u", None), (7, "u", ""), (8, "x\r\ny: z", "a\r\n\r\nWARC/1.1 b"), (None, "n", "q")]
    return rows + [(100 + i, "u", chr(65 + i % 26) * (i * 37)) for i in range(60)]


def want(rows):
    top = {}
    for p, _, h in rows:
        if len((h or "").encode()) >= 1000:
            top[h] = max(p, top.get(h, p))
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        again = h in top and top[h] != p
        out.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top[h] if again else None))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int").repartition(3)


def test_round_trip(spark):
    assert sorted((tuple(r) for r in W.warc_round_trip(frame(spark, pages())).collect()), key=str) == want(pages())


def test_small_splits_and_filters(spark, tmp_path):
    W.write(W.records(frame(spark, pages())), f"file://{tmp_path}/w")
    for split in (100, 700, 5000):
        got = W.read(spark, f"file://{tmp_path}/w", split=split)
        assert sorted(r.record_id or "" for r in got.collect()) == sorted(str(p) if p else "" for p, _, _ in pages())
        assert got.where("record_type = 'revisit'").count() == 2
        assert got.where("target_uri = 'http://a/2'").select("record_id").collect()[0].record_id == "2"
    assert all(r.payload is None for r in W.read(spark, f"file://{tmp_path}/w", payload=False).collect())


def test_reader_skips_what_it_does_not_want(tmp_path, monkeypatch):
    path = tmp_path / "a.warc.gz"
    row = {"record_id": "1", "record_type": "response", "target_uri": None, "refers_to": None, "payload_digest": None, "payload_bytes": 5, "payload": b"12345"}
    path.write_bytes(W.pack(row) + W.pack(row | {"record_id": "2", "record_type": "revisit", "payload": None}))
    reader = W.WarcReader({"path": str(tmp_path)})
    reader.wanted = {"record_type": {"revisit"}}
    monkeypatch.setattr(W.WarcReader, "_inflate", lambda *a: 1 / 0)
    assert [b.column(0).to_pylist() for p in reader.partitions() for b in reader.read(p)] == [["2"]]


def test_blocks_without_http_head(tmp_path):
    row = {"record_id": "1", "record_type": "resource", "target_uri": "u", "refers_to": None, "payload_digest": None, "payload_bytes": None, "payload": b"hello"}
    raw = W.pack(row | {"payload": None})
    head = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:quillon:7>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(head) + raw)  # a writer that leaves the lengths out
    reader = W.WarcReader({"path": str(tmp_path)})
    got = [(r["record_id"], r["payload"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert got == [("7", b"hello"), ("1", None)]
    assert b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" in gzip.decompress(W.pack(row | {"record_type": "revisit", "payload": None}))


def test_repeated_rows(spark):
    rows = [(1, "u", "z" * 1200), (1, "u", "z" * 1200), (2, "u", "z" * 1200), (None, None, None), (None, None, None)]
    assert sorted((tuple(r) for r in W.warc_round_trip(frame(spark, rows)).collect()), key=str) == want(rows)


def test_empty_table(spark):
    assert W.warc_round_trip(frame(spark, [])).collect() == []

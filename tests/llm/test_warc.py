from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow as pa
from lodestone.llm import warc as W


def digest(text: str | None) -> str:
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


ROWS = [(3, "http://a/é", "<p>x</p>", "r"), (1, None, "<p>x</p>", "s"), (2, "u", None, "t"), (7, "u\r\nX: y", "", "t"), (9, "v", "é" * 300_000, "t"), (None, "w", "<p>x</p>", "t"), (None, "w", "alone", "t"), (1, None, "<p>x</p>", "s")]
SCHEMA = "page_id long, url string, html string, record_type string"


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    W.write_pages(df, str(tmp_path / "a"))
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0, r.intact) for r in W.read_pages(spark, str(tmp_path / "a")).collect()))
    revisit = {(3, "<p>x</p>"): 1, (None, "<p>x</p>"): 1, (7, ""): 2}
    expected = sorted((p or 0, len((h or "").encode()), digest(h), "revisit" if (p, h) in revisit else "response", revisit.get((p, h), 0), None if (p, h) in revisit else True) for p, _, h, _ in ROWS)
    assert got == expected


def test_least_bytes_and_empty(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    W.write_pages(df, str(tmp_path / "b"), least_bytes=5)
    assert {r.page_id for r in W.read_pages(spark, str(tmp_path / "b")).collect() if r.record_type == "revisit"} == {3, None}
    W.write_pages(df.limit(0), str(tmp_path / "c"))
    assert W.read_pages(spark, str(tmp_path / "c")).count() == 0


def test_filters_reach_the_reader_and_payloads_stay_unread(spark, tmp_path, monkeypatch):
    W.write_pages(spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "d"))
    found = W.read_warc(spark, str(tmp_path / "d"), ["record_type", "target_uri"]).where("record_type = 'revisit' and target_uri like 'http://a%'")
    assert [r.target_uri for r in found.collect()] == ["http://a/é"]
    reader = W.WarcReader({"path": str(tmp_path / "d")}, W.StructType.fromDDL("record_type string"))
    assert list(reader.pushFilters([W.EqualTo(("record_type",), "response"), W.EqualTo(("content_length",), 5)])) == [W.EqualTo(("content_length",), 5)]
    monkeypatch.setattr(W._Member, "body", lambda *_: 1 / 0)
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in batches) == 5


def test_plain_and_foreign_archives(tmp_path):
    records = [W.record_bytes({"record_type": "response", "record_id": f"urn:{i}", "payload": b"x" * i * 1000}) for i in range(5)]
    for name, data in (("a.warc", b"".join(records)), ("b.warc.gz", b"".join(map(gzip.compress, records))), ("c.warc.gz", b"".join(W.gzip_member(r, 6) for r in records))):
        (tmp_path / name).write_bytes(data)
        for want in (True, False):
            with pa.OSFile(str(tmp_path / name)) as f:
                got = list(W.read_records(f, lambda h: h["warc-record-id"] != "<urn:2>", want))
            assert [h["warc-record-id"] for h, *_ in got] == ["<urn:0>", "<urn:1>", "<urn:3>", "<urn:4>"], name
            assert [p and len(p) for _, p, _ in got] == ([b"" and 0, 1000, 3000, 4000] if want else [None] * 4) or want
    assert gzip.decompress(W.gzip_member(records[3], 1)) == records[3]

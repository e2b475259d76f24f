import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import warc

SCHEMA = "page_id long, url string, html string, sha1 string, salt int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


ROWS = [
    (1, "http://a.example/x", "é" * 600),
    (2, None, "é" * 600),
    (9, "http://a.example/ü?q=%41\r\nX: y", "é" * 600),
    (9, "http://a.example/", "é" * 600),
    (3, "u", "short"),
    (4, "u", "short"),
    (5, "u", None),
    (6, "u", ""),
    (7, "u", "\r\n\r\nWARC/1.1\r\n" * 100000),
    (None, "u", "z" * 2000),
    (8, "u", "z" * 2000),
    (None, "u", "y" * 2000),
]


def brute(rows):
    out = []
    for i, (page, _, html) in enumerate(rows):
        data = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == data and r[0] is not None]
        revisit = len(data) >= 1000 and bool(same) and page != max(same)
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    return sorted(out, key=str)


def test_round_trip_equals_brute_force(spark):
    manifest = warc.write(pages(spark, ROWS), archive_bytes=2000)
    assert manifest.count() > 2
    got = warc.read(manifest, keep_payload=True).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute(ROWS)
    held = {r["page_id"]: r["payload"] for r in got if r["record_type"] == "response"}
    assert bytes(held[7]).decode() == ROWS[8][2]


def test_archives_are_plain_gzip(spark):
    path = warc.write(pages(spark, ROWS[4:6])).first()["path"].removeprefix("file:")
    assert gzip.open(path).read().startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")


def member(payload=b"abc", **change):
    raw = warc.record(1, "u", payload, hashlib.sha1(payload).digest(), None)
    for a, b in change.values():
        raw = raw.replace(a, b)
    return warc._member(raw)


@pytest.mark.parametrize(
    "data",
    [
        member(x=(b"abc", b"abd")),
        member()[:-9],
        member(x=(b"\r\n\r\nabc\r\n\r\n", b"\r\n\r\nabcd\r\n\r\n")),
        member(x=(b"Payload-Digest: sha1:", b"Payload-Digest: sha1:" + b"A" * 32 + b"\r\nX: ")),
        warc._member(b"something else\r\n\r\n"),
    ],
)
def test_damage_is_an_error(data):
    with pytest.raises((warc.BadRecord, KeyError)):
        list(warc.records(io.BytesIO(member() + data)))


def test_members_of_any_size_in_small_pieces(monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 7)
    rng = random.Random(0)
    payloads = [rng.randbytes(rng.choice([0, 1, 10, 3000])) for _ in range(20)]
    got = list(warc.records(io.BytesIO(b"".join(member(p) for p in payloads)), keep_payload=True))
    assert [r["payload"] for r in got] == payloads


def test_empty_table(spark):
    assert warc.read(warc.write(pages(spark, []))).count() == 0


def test_hot_payload(spark):
    rows = [(i, "u", "k" * 1500) for i in range(500)] + [(1000 + i, "u", str(i) * 900) for i in range(50)]
    got = warc.read(warc.write(pages(spark, rows)))
    assert got.where("record_type = 'revisit' and refers_to = 499").count() == 499 and got.count() == 550
    assert got.agg(F.countDistinct("payload_digest")).first()[0] == 51


def test_store_names():
    assert warc.arrow_uri("s3a://bucket/key") == "s3://bucket/key" and warc.arrow_uri("file:/tmp/x") == "file:/tmp/x"
    assert warc.arrow_uri("hdfs://name:8020/x") == "hdfs://name:8020/x" and warc.arrow_uri("abfss://c@a/x") == "abfs://c@a/x"


def test_very_long_and_repeated_payloads(spark):
    rows = [(i, None, "<p>" + "long " * 400_000) for i in range(6)] + [(None, None, None)] * 3
    got = warc.read(warc.write(pages(spark, rows))).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute(rows)
    assert warc.read(warc.write(pages(spark, []))).count() == 0

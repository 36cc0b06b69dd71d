import base64
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import warc
from ledgerloom.llm.common import workspace

PAGE = "page_id long, url string, html string"


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows):
    first, count = {}, {}
    for p, _, h in rows:
        k = h or ""
        first[k] = p if first.get(k) is None else first[k] if p is None else min(first[k], p)
    out, used = [], set()
    for p, _, h in rows:
        k = h or ""
        own = p == first[k] and k not in used
        used |= {k} if own else set()
        out.append((p, len(k.encode()), b32(k), "response" if own else "revisit", None if own else first[k]))
    return sorted(out, key=str)


ROWS = [(5, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (9, None, None), (7, "u\r\nx", ""), (1, "c", "x" * 200_000), (None, "n", "<p>é</p>"), (3, "same", "twice"), (3, "same", "twice"), (11, "d", "one\r\n\r\ntwo")]


def test_round_trip_equals_brute_force(frame):
    got = sorted(map(tuple, warc.digests(frame(ROWS, PAGE)).collect()), key=str)
    assert got == brute(ROWS)


def test_payloads_come_back_whole_and_selected(spark, frame):
    folder = workspace(spark, "warc-test")
    index = warc.write(frame(ROWS, PAGE), folder)
    assert index.count() == len(ROWS)
    got = {r["page_id"]: bytes(r["payload"]) for r in warc.read(index.where("record_type = 'response'"), folder, gap=0, block=1000, most=1000).collect()}
    assert got[1] == b"x" * 200_000 and got[2] == "<p>é</p>".encode() and got[11] == b"one\r\n\r\ntwo"


def test_small_payloads_stay_responses(frame):
    got = warc.round_trip(frame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "long one"), (4, "d", "long one")], PAGE), min_bytes=5)
    assert {r["page_id"]: r["record_type"] for r in got.collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_empty_table_and_extra_columns(frame):
    assert warc.digests(frame([], PAGE)).count() == 0
    got = warc.digests(frame([(1, "a", "x", "z")], PAGE + ", payload_digest string"))
    assert got.select("payload_digest").first()[0] == b32("x")


def test_a_third_of_pages_alike(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("html"))
    got = warc.digests(pages)
    assert got.where("record_type = 'revisit' AND refers_to = 0").count() == 999


def test_damaged_records_are_errors():
    made = warc.record(1, "u", b"abc", "response", None, b32("abc"))
    fields, payload = warc.parse(made)
    assert payload == b"abc" and fields["WARC-Payload-Digest"] == "sha1:" + b32("abc")
    with pytest.raises(ValueError):
        warc.parse(made[:-3])
    assert zlib.crc32(made) == zlib.crc32(warc.record(1, "u", b"abc", "response", None, b32("abc")))


def test_read_back_is_dealt_to_many_tasks(spark, frame):
    rows = [(i, f"http://x/{i}", f"page {i} " * 50) for i in range(400)]
    folder = warc.workspace(spark, "many")
    index = warc.write(frame(rows, "page_id long, url string, html string"), folder)
    read = warc.read(index, folder, block=1000)
    assert read.rdd.getNumPartitions() >= index.agg({"length": "sum"}).first()[0] // 1000
    assert sorted(r["page_id"] for r in read.collect()) == list(range(400))

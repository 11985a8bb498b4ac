"""Archives: written, read back, and records that are broken or out of order."""

import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from finsearch.llm import warc


def b32(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


@pytest.mark.parametrize("size", [0, 1, 99, 100, 101, 12_345])
def test_chunked_framing(size):
    payload = random.Random(size).randbytes(size)
    assert warc.unchunked(warc.chunked(payload, 100)) == payload
    assert warc.unchunked(warc.chunked(payload, 100)[:-5]) is None
    assert warc.unchunked(b"5;name=value\r\nhello\r\n0\r\n\r\n") == b"hello"
    assert warc.unchunked(b"zz\r\nhello\r\n0\r\n\r\n") is None
    assert warc.unchunked(b"9\r\nhello\r\n0\r\n\r\n") is None


def pages(spark):
    hot = "<p>the same page many times</p>" * 5
    rows = [(i, f"http://h/{i} x", f"<p>page {i} é 😀</p>\r\n\r\nWARC/1.1\r\n" * (i % 40)) for i in range(120)]
    rows += [(1000 + i, None, hot) for i in range(150)]
    rows += [(2000, "u", None), (2001, "u", ""), (None, "u", "null id"), (2002, "u", "twice" * 100), (2002, "u", "twice" * 100), (None, "v", hot)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("mine")).withColumn("sha1", F.lit(1))


@pytest.mark.parametrize("segment,min_bytes", [(64, 0), (1 << 20, 0), (200, 100)])
def test_write_and_read_back(spark, tmp_path, segment, min_bytes):
    rows, source = pages(spark)
    path = str(tmp_path / "archives")
    warc.write_archives(source.repartition(5), path, min_bytes, segment)
    records = warc.read_archives(spark, path)
    if segment == 64:
        assert records.where("record_type = 'continuation'").count() > 100
    whole = warc.decoded(warc.reassembled(records))
    payloads = sorted(bytes(r["payload"]) for r in whole.where("record_type = 'response'").collect())
    got = sorted(
        (r["page_id"] or "", r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or "", r["complete"])
        for r in warc.page_records(whole).collect()
    )
    largest = {}
    for i, _, html in rows:
        if i is not None:
            largest[html or ""] = max(i, largest.get(html or "", i))
    expected, stored = [], []
    for i, _, html in rows:
        text = html or ""
        size, to = len(text.encode()), largest.get(text)
        own = to is None or to == i or size < min_bytes
        expected.append(("" if i is None else str(i), size, b32(text), "response" if own else "revisit", "" if own else str(to), True))
        stored += [text.encode()] * own
    assert got == sorted(expected)
    assert payloads == sorted(stored)


def test_files_are_archives(spark, tmp_path):
    path = str(tmp_path / "one")
    warc.write_archives(spark.createDataFrame([(1, "http://a/", "<p>é</p>")], "page_id long, url string, html string"), path)
    part = next(p for p in (tmp_path / "one").iterdir() if p.name.startswith("part-"))
    data = gzip.decompress(part.read_bytes())
    head, block = data.split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"WARC-Target-URI: http://a/" in head
    assert block.endswith(b"0\r\n\r\n\r\n\r\n") and f"WARC-Payload-Digest: sha1:{b32('<p>é</p>')}".encode() in head


def test_missing_and_wrong_segments(spark):
    def of(page, drop=(), twist=False):
        records = warc.records_of(page, "u", b"payload " * 100, warc.digest32(b"payload " * 100), None, "2024-01-01T00:00:00Z", 100)
        parsed = [next(warc.parsed(r + b"\r\n\r\n")) for i, r in enumerate(records) if i not in drop and not (drop == ("last",) and r is records[-1])]
        return [(*p[:-1], p[-1][:-1] if twist and i == 2 else p[-1]) for i, p in enumerate(parsed)]

    rows = of(1) + of(2, drop=(3,)) + of(3, drop=(0,)) + of(4, drop=("last",)) + of(5, twist=True) + of(6)[:1]
    random.Random(0).shuffle(rows)
    records = spark.createDataFrame(rows, warc.RECORD).repartition(3)
    found = warc.decoded(warc.reassembled(records)).collect()
    assert {(r["page_id"], r["complete"]) for r in found} == {("1", True), ("2", False), (None, False), ("4", False), ("5", False), ("6", False)}
    assert [r["payload"] for r in found if r["page_id"] == "1"] == [b"payload " * 100]
    with pytest.raises(ValueError):
        list(warc.parsed(b"no record"))


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.page_records(warc.decoded(warc.reassembled(warc.read_archives(spark, path)))).count() == 0

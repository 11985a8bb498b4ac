"""WARC archives: records with chunked HTTP payloads, cut into segments, and their reassembly.

Long records are written as segments: a first record and continuations that name it as origin.
Reading groups the segments by origin, orders them by number, verifies the total length, removes
the chunked transfer framing and verifies the payload's digest. Equal payloads are stored once;
the others are revisit records that refer to the stored one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = 32 * 1024  # bytes of a record's block
CHUNK = 8 * 1024  # bytes of a chunk of the transfer framing
RECORDS_PER_FILE = 2000
SALTS = 16
BATCH_BYTES = 8 << 20

# Line ends and field names of the archive format.
END = b"\r\n"
VERSION = b"WARC/1.1"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    parts = (payload[at : at + size] for at in range(0, len(payload), size))
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; none if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(END, at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        at = end + 2
        if not size:
            return b"".join(out)
        out.append(body[at : at + size])
        if len(out[-1]) < size or body[at + size : at + size + 2] != END:
            return None
        at += size + 2


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _record(fields: dict[str, str | int | None], block: bytes) -> bytes:
    """One record without the empty lines behind it, which the writer puts there."""
    lines = [f"{k}: {v}".encode() for k, v in fields.items() if v is not None]
    return END.join([VERSION, *lines, b"Content-Length: %d" % len(block), b"", block])


def records_of(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page: a revisit, a response, or a response and its continuations."""
    own = record_id(page_id, digest)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:x-unknown"
    common = {"WARC-Record-ID": own, "WARC-Date": date, "WARC-Target-URI": uri, "X-Page-ID": page_id, "WARC-Payload-Digest": f"sha1:{digest}"}
    kind = {"Content-Type": "application/http; msgtype=response"}
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        profile = {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        revisit = {"WARC-Type": "revisit", **common, **profile, "WARC-Refers-To": record_id(refers_to, digest), **kind}
        return [_record(revisit, head)]
    block = head + chunked(payload)
    blocks = [block[at : at + segment] for at in range(0, len(block), segment)]
    if len(blocks) == 1:
        return [_record({"WARC-Type": "response", **common, **kind}, block)]
    out = [_record({"WARC-Type": "response", **common, "WARC-Segment-Number": 1, **kind}, blocks[0])]
    for number, part in enumerate(blocks[1:], 2):
        fields = {
            "WARC-Type": "continuation",
            "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{own}#{number}')}>",
            "WARC-Date": date,
            "WARC-Segment-Origin-ID": own,
            "WARC-Segment-Number": number,
            "WARC-Segment-Total-Length": len(block) if number == len(blocks) else None,
        }
        out.append(_record(fields, part))
    return out


def write_archives(
    pages: DataFrame, path: str, min_bytes: int = 0, segment: int = SEGMENT, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id"
) -> None:
    """Write ``pages(id, url, html)`` as gzipped archives of bounded size below ``path``.

    The payload is the html in UTF-8, empty for null. Of equal payloads of at least ``min_bytes``
    the one with the largest id is stored, others refer to it; a null id is never the largest
    unless all are null, and repeated rows of the largest id are all stored. A payload that many pages
    share is dealt out over several tasks.
    """
    source = pages.select(F.col(id_col).alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    source = source.withColumn("sha1", F.sha1("payload")).withColumn("salt", F.pmod(F.hash("page_id", "url"), F.lit(SALTS)))
    held = source.where(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("stored"), F.count("*").alias("n"))
    shared = held.where("n > 1 and stored is not null").select("sha1", "stored", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    marked = source.join(shared, ["sha1", "salt"], "left").select(
        "page_id", "url", "payload", F.when(F.col("page_id").eqNullSafe(F.col("stored")), F.lit(None)).otherwise(F.col("stored")).alias("refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                found = records_of(page_id, url, payload, digest32(payload), refers_to, date, segment)
                out += found
                size += sum(map(len, found))
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    # bytes pass through a string column as they are
    rows = marked.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


RECORD = "record_id string, record_type string, uri string, page_id string, digest string, refers_to string, origin string, number int, total long, block binary"
FIELDS = ["WARC-Record-ID", "WARC-Type", "WARC-Target-URI", "X-Page-ID", "WARC-Payload-Digest", "WARC-Refers-To", "WARC-Segment-Origin-ID"]


def parsed(data: bytes) -> Iterator[tuple]:
    """The records of an archive, in order. A cut-off last record comes with the bytes that are there."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        start = end + 4
        size = int(fields["Content-Length"])
        number, total = fields.get("WARC-Segment-Number"), fields.get("WARC-Segment-Total-Length")
        yield (*[fields.get(f) for f in FIELDS], number and int(number), total and int(total), data[start : start + size])
        at = start + size + 4


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in RECORD.split(", "))])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow_schema()
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for row in parsed(zlib.decompress(content.as_py(), 47)):
                    rows.append(row)
                    size += len(row[-1])
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def reassembled(records: DataFrame) -> DataFrame:
    """``records`` with segments joined: one row per whole record, and ``complete``.

    Segments are grouped by origin and ordered by number. A record is complete if its numbers run
    from 1 without a gap and its length is the announced total. The first segment may have come
    several times; then so does the record. Whole records pass without a shuffle.
    """
    names = [c.split()[0] for c in RECORD.split(", ")]
    whole = records.where("number is null").withColumn("complete", F.lit(True))
    parts = records.where("number is not null").withColumn("origin", F.coalesce("origin", "record_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow_schema().append(pa.field("complete", pa.bool_()))
        origin, held = None, {}

        def joined() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            numbers = sorted(held)
            block = b"".join(held[n][0]["block"] for n in numbers)
            first, last = held[numbers[0]][0], held[numbers[-1]][0]
            complete = numbers == [*range(1, len(numbers) + 1)] and last["total"] == len(block)
            row = first | {"block": block, "complete": complete}
            for _ in range(held[numbers[0]][1]):
                yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                if row["origin"] != origin:
                    yield from joined()
                    origin, held = row["origin"], {}
                seen = held.get(row["number"])
                held[row["number"]] = (row, 1 if seen is None else seen[1] + 1)
        yield from joined()

    sorted_parts = parts.select(*names).repartition("origin").sortWithinPartitions("origin", "number")
    return whole.unionByName(sorted_parts.mapInArrow(run, f"{RECORD}, complete boolean"))


def decoded(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """Whole records with the transfer framing removed: ``payload``, its size, digest and whether all of it is right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, right, payloads = [], [], [], []
            kinds, said, complete, blocks = (batch.column(i).to_pylist() for i in (1, 4, 6, 7))
            for kind, announced, whole, block in zip(kinds, said, complete, blocks):
                payload = None
                if kind == "response":
                    head, _, body = block.partition(b"\r\n\r\n")
                    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                digest = None if payload is None else digest32(payload)
                sizes.append(None if payload is None else len(payload))
                digests.append(digest or (announced or "").removeprefix("sha1:") or None)
                right.append(whole and (kind != "response" or f"sha1:{digest}" == announced))
                payloads.append(payload if with_payload else None)
            kept = [batch.column(i) for i in (0, 1, 2, 3, 5)]
            made = [pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(right, pa.bool_()), pa.array(payloads, pa.binary())]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=["record_id", "record_type", "uri", "page_id", "refers_to", "payload_digest", "payload_bytes", "complete", "payload"])

    schema = "record_id string, record_type string, uri string, page_id string, refers_to string, payload_digest string, payload_bytes long, complete boolean, payload binary"
    return records.select("record_id", "record_type", "uri", "page_id", "digest", "refers_to", "complete", "block").mapInArrow(run, schema)


def page_records(records: DataFrame) -> DataFrame:
    """Per page: size and digest of the full payload, kind of record, and the page that a revisit refers to.

    Revisits look up the record they name; many of them may name the same one, which is one row there.
    """
    own = records.where("record_type = 'response'")
    target = own.groupBy(F.col("record_id").alias("refers_to")).agg(
        F.max("page_id").alias("to"), F.max("payload_bytes").alias("bytes"), F.min("complete").alias("right")
    )
    revisits = records.where("record_type = 'revisit'").join(target, "refers_to", "left")
    columns = ["page_id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete"]
    return own.withColumn("refers_to", F.lit(None).cast("string")).select(columns).unionByName(
        revisits.select("page_id", "uri", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("to").alias("refers_to"), F.coalesce("right", F.lit(False)).alias("complete"))
    )

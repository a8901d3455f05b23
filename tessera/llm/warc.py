"""WARC archives compressed record by record with a dictionary of their own.

``write(pages, path)`` makes one WARC record per page.  Each archive file starts with a Zstandard
skippable frame that holds a dictionary trained on a bounded sample of the archive's own records;
each record is then a frame of its own.  Of records with equal payloads of at least ``min_payload``
bytes, the one with the largest page_id is the response and the others are revisits of it.
``read(spark, path)`` opens archives again.

Files are written by Spark's text writer, which puts a line feed after each value: every archive
ends with the header of a one-byte skippable frame, whose content that line feed is.

Defined cases: null html is an empty payload; a null page_id never is referred to and is a
response; rows with the page_id and the payload of a response are responses as well and have its
record id (others have their own); an empty table makes no archive; further columns are ignored.
An archive of too few records to train a dictionary on has the beginning of them as one.
"""

from __future__ import annotations

import base64
import io
import re
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ARCHIVE_BYTES = 16_000_000
DICTIONARY_BYTES = 32_768
#: Bound of the sample that a dictionary is trained on, and of what one record adds to it.
SAMPLE_BYTES, SAMPLE_EACH = 400_000, 8_000
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the formats: the magic numbers of skippable frames and the profile of revisits.
SKIPPABLE_DICTIONARY = 0x184D2A5D
SKIPPABLE_END = 0x184D2A50
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _record(page_id, url, length: int, sha1: str, top, html: bytes | None) -> bytes:
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if top is None else 'revisit'}",
        f"WARC-Record-ID: <urn:{f'page:{page_id}:{digest}' if page_id is not None else f'uuid:{uuid.uuid4()}'}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if top is None:
        body += html or b""
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{top}:{digest}>"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def archive(records: list[bytes], level: int = LEVEL) -> bytes:
    """The bytes of an archive, but for the line feed that its last frame announces."""
    import zstandard

    step = max(1, sum(min(len(r), SAMPLE_EACH) for r in records) // SAMPLE_BYTES)
    sample = [r[:SAMPLE_EACH] for r in records[::step]]
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=512, d=8)
    except zstandard.ZstdError:  # too few records to learn from: the beginning of the sample itself, as content
        dictionary = zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = dictionary.as_bytes()
    out = [struct.pack("<II", SKIPPABLE_DICTIONARY, len(raw)) + raw]
    compress = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True).compress
    out += map(compress, records)
    return b"".join(out) + struct.pack("<II", SKIPPABLE_END, 1)


def _archives(batches):
    records, size = [], 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "length", "sha1", "top", "html")]
        for row in zip(*columns, strict=True):
            records.append(_record(*row))
            size += len(records[-1])
            if size >= ARCHIVE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([archive(records)], pa.binary())], ["archive"])
                records, size = [], 0
    if records:
        yield pa.RecordBatch.from_arrays([pa.array([archive(records)], pa.binary())], ["archive"])


def parse(content: bytes):
    """Rows of RECORD from the bytes of an archive."""
    import zstandard

    dictionary = None
    if content[:4] == struct.pack("<I", SKIPPABLE_DICTIONARY):
        dictionary = zstandard.ZstdCompressionDict(content[8 : 8 + struct.unpack_from("<I", content, 4)[0]])
    reader = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(content), read_across_frames=True)
    text = io.BufferedReader(reader, 1 << 20)
    number = lambda s: int(m[1]) if (m := re.search(r"<urn:page:(-?\d+):", s or "")) else None
    while (line := text.readline()) :
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := text.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode("utf-8", "replace").rstrip("\r\n").partition(": ")
            head[k.lower()] = v
        block = text.read(int(head["content-length"]))
        text.read(4)
        http, _, payload = block.partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
        yield number(head["warc-record-id"]), head["warc-target-uri"], length, head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"], number(head.get("warc-refers-to")), payload if head["warc-type"] == "response" else None


def _parsed(payloads: bool):
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*found, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                found, size = [], 0
                for r in parse(content.as_py()):
                    found.append(r if payloads else (*r[:6], None))
                    size += len(r[6] or b"")
                    if size > 8_000_000 or len(found) >= 2_000:
                        yield rows(found)
                        found, size = [], 0
                if found:
                    yield rows(found)

    return run


def plan(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """page_id, url, length, sha1, top (the page that a revisit refers to, else null), html (null for revisits)."""
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html")).withColumns({"sha1": F.sha1("html"), "length": F.octet_length("html").cast("long")})
    # Only ids and digests meet here; the counts are summed before they are shuffled, so a payload that many pages share is a few rows.
    keys = whole.select("page_id", "sha1", "length").filter((F.col("length") >= min_payload) & F.col("page_id").isNotNull())
    tops = common.cut(keys.groupBy("sha1", "length").agg(F.max("page_id").alias("top"), F.min("page_id").alias("least")).filter("least < top").select("sha1", "length", "top"), "warc-tops")
    # Written, so that Spark knows their size: few revisits are sent to the pages, and no page is shuffled for them.
    revisits = common.cut(keys.join(tops, ["sha1", "length"]).filter("page_id < top").select("page_id", "sha1", "top").distinct(), "warc-revisits")
    return whole.join(revisits, ["page_id", "sha1"], "left").select("page_id", "url", "length", "sha1", "top", F.when(F.col("top").isNull(), F.col("html")).alias("html"))


def write(pages: DataFrame, path: str, min_payload: int = 0) -> None:
    common.prepare(pages.sparkSession)
    archives = plan(pages, min_payload).mapInArrow(_archives, "archive binary")
    archives.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    common.prepare(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_parsed(payloads), RECORD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.home(spark)}/warc-{uuid.uuid4().hex}"
    write(common.table(spark, sf_dir, "pages"), path)
    return read(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op5_warc": query}
_GROUPS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * g + 1}, 5))::BIGINT >> {shift}) & 31)::INT + 1, 1)" for g in range(8) for shift in (15, 10, 5, 0))
ORACLES = {
    "op5_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') html, sha1(coalesce(html, '')) h, max(page_id) OVER (PARTITION BY coalesce(html, '')) top FROM pages)
SELECT page_id, strlen(html)::BIGINT payload_bytes, {_GROUPS} payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END record_type, CASE WHEN page_id < top THEN top END refers_to FROM p"""
}

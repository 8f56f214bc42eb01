"""WARC archives: written by Spark's text sink, read back by length, assembled by joins on identifiers.

A record is header, empty line, block; the text sink ends every row with the two line
breaks that end a WARC record, so the files are plain (gzip) WARC on any file system
that Spark writes. Reading follows Content-Length, so a block may hold anything.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm.shared import need_numbers, shared_folder, table

RECORDS_PER_FILE = 30_000
BYTES_PER_FILE = 1 << 28  # of payloads, about: an archive is read as one value
SALTS = 16
LEAST_BYTES = 0
_END = "\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD = (
    "capture string, type string, record_id string, target_uri string, refers_to string, head string, "
    "payload binary, payload_bytes long, payload_digest string, intact boolean, page_id long"
)


def base32(digest: Column) -> Column:
    """Upper-case base32 of a 40-digit hex digest: five hex digits are four base-32 digits."""

    def four(part: Column) -> Column:
        number = F.conv(part, 16, 10).cast("int")
        return F.concat(*(F.substring(F.lit(_BASE32), F.shiftright(number, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)))

    return F.concat(*(four(F.substring(digest, i, 5)) for i in range(1, 41, 5)))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """Header lines (null values leave their line out), empty line, block."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines, length), F.lit(_END), block)


def write_archives(pages: DataFrame, path: str, least: int = LEAST_BYTES, date: str = "2024-01-01T00:00:00Z") -> None:
    """A request, a response (or revisit) and a metadata record per row of pages (page_id, url, html).

    Of rows with equal payloads of at least `least` bytes, those with the smallest
    page_id are responses, the others revisit them; null page_ids come last. A null html
    is an empty payload. Rows that repeat a page_id stay captures of their own. Line
    breaks in a url, which would end its header line, are percent-encoded; a page of any
    length is one record; an empty table gives archives without records. page_id must be a
    whole number (or null), else a ValueError names it. A null url is an empty one, also
    when it is read back; encoded line breaks stay encoded.
    """
    need_numbers(pages, "page_id")
    url = F.replace(F.replace(F.coalesce(F.col("url"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    mean, most = pages.agg(F.avg(F.octet_length("html")), F.max(F.octet_length("html"))).first()
    per_file = min(RECORDS_PER_FILE, 3 * max(1, int(BYTES_PER_FILE / max(1, 2 * (mean or 0), (most or 0) / 16))))
    rows = pages.select("page_id", url.alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("hex", F.sha1("html")).withColumn("digest", base32(F.col("hex"))).withColumn("row", F.monotonically_increasing_id())
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    first = rows.groupBy("digest").agg(F.min(order).alias("first"))
    # a payload that many pages share is dealt out to several tasks
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.hash("row"), F.lit(SALTS))).join(first, ["digest", "salt"])
    revisit = (F.octet_length("html") >= least) & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    urn = lambda p, r, kind: F.concat(F.lit("<urn:capture:"), p, F.lit(":"), r.cast("string"), F.lit(f":{kind}>"))
    own = lambda kind: urn(page, F.col("row"), kind)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(_END))
    when = ("WARC-Date", F.lit(date))
    uri = ("WARC-Target-URI", F.col("url"))
    together = ("WARC-Concurrent-To", own("response"))
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", own("request")), when, uri, together, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{_END}")))
    response = _record(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", own("response")),
            when,
            uri,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Refers-To", F.when(revisit, urn(F.coalesce(F.col("first.page_id").cast("string"), F.lit("")), F.col("first.row"), "response"))),
            ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(revisit, http).otherwise(F.concat(http, F.col("html"))),
    )
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", own("metadata")), when, uri, together, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("page-id: "), page, F.lit("\r\n")))
    records = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    records.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a WARC stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        if not fields.get("content-length", "").isdigit():
            raise ValueError(f"a record without Content-Length: {fields}")
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a record is cut short")
        yield fields, block


def _row(fields: dict[str, str], block: bytes) -> tuple:
    kind = fields.get("warc-type", "")
    own = fields.get("warc-record-id", "")
    payload = size = digest = intact = page = None
    head = block
    if kind in ("response", "revisit"):
        head, _, body = block.partition(b"\r\n\r\n")
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "response":
            payload, size = body, len(body)
            intact = b32encode(hashlib.sha1(body).digest()).decode() == digest
        else:
            lines = dict(line.lower().split(b":", 1) for line in head.split(b"\r\n")[1:])
            size = int(lines.get(b"content-length", 0))
    elif kind == "metadata":
        found = block.partition(b"page-id:")[2].split(b"\r\n")[0].strip()
        page = int(found) if found else None
    return (fields.get("warc-concurrent-to", own), kind, own, fields.get("warc-target-uri"), fields.get("warc-refers-to"), head.decode("utf-8", "replace"), payload, size, digest, intact, page)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row of RECORD per record of the gzip or plain WARC files under `path`."""
    schema = pa.schema([("capture", pa.string()), ("type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("head", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_()), ("page_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                raw = io.BytesIO(content.as_buffer())
                stream = gzip.GzipFile(fileobj=raw) if raw.read(2) == b"\x1f\x8b" else raw
                raw.seek(0)
                rows, size = [], 0
                for fields, block in parse(stream):
                    rows.append(_row(fields, block))
                    size += len(block)
                    if size > 1 << 22 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def transactions(records: DataFrame, payload: bool = True) -> DataFrame:
    """One nested row per capture: request, response (or revisit) and metadata that name the same record.

    A record belongs to the capture that its WARC-Concurrent-To names, or else to its
    own. Missing parts are null.
    """
    part = lambda kinds, *columns: F.first(F.when(F.col("type").isin(*kinds), F.struct(*columns)), ignorenulls=True)
    answer = ("type", "record_id", "refers_to", "head", "payload_bytes", "payload_digest", "intact", *(["payload"] if payload else []))
    return records.groupBy("capture").agg(
        F.first("target_uri", ignorenulls=True).alias("target_uri"),
        part(["request"], "record_id", "head").alias("request"),
        part(["response", "revisit"], *answer).alias("response"),
        part(["metadata"], "record_id", "head", "page_id").alias("metadata"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    captures = transactions(read_archives(spark, path), payload=False)
    refers = F.regexp_extract("response.refers_to", r"^<urn:capture:(-?\d+):", 1)
    return captures.select(
        F.col("metadata.page_id").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
    )


SQL = """
WITH hashed AS (SELECT page_id, encode(coalesce(html, '')) AS p, sha1(coalesce(html, '')) AS h FROM pages),
coded AS (
  SELECT page_id, octet_length(p)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest
  FROM hashed),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM coded)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> least THEN least END AS refers_to FROM firsts
"""

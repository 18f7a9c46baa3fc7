"""WARC archives: written by Spark's text writer, read from whole files, assembled into one nested row per capture."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Captures that an archive file has at most, and bytes of payloads: with larger pages a file takes fewer of them.
FILE_CAPTURES, FILE_BYTES = 3_000, 192 << 20
#: Payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000

RECORD = "record_id string, type string, concurrent_to string, target_uri string, digest string, payload binary, payload_bytes long, payload_sha1 string, fields map<string,string>"


def captures(pages: DataFrame) -> DataFrame:
    """page_id, url, payload text, its bytes and SHA-1, and the page it revisits with its url (null: none).

    Of pages with equal payloads of at least REVISIT_BYTES the largest page_id keeps the payload (a repeated row of it,
    too); the others refer to it. A null page_id is a page of its own and never referred to. Groups of equal payloads
    are reduced by digest map-side, and only the revisits, without payloads, go back to their pages.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select("page_id", "url", body.alias("payload"))
    base = base.withColumns({"n": F.octet_length("payload").cast("long"), "sha1": F.sha1(F.col("payload").cast("binary"))})
    small = base.filter(F.col("n") >= REVISIT_BYTES).select("page_id", "n", "sha1", "url")
    first = small.groupBy("sha1", "n").agg(F.max(F.struct("page_id", "url")).alias("m"), F.count(F.lit(1)).alias("c")).withColumn("first", F.col("m.page_id")).filter("c > 1 AND first IS NOT NULL").select(F.col("sha1").alias("f_sha1"), F.col("n").alias("f_n"), "first", F.col("m.url").alias("first_url"))
    revisit = small.join(first, (F.col("sha1") == F.col("f_sha1")) & (F.col("n") == F.col("f_n"))).filter("page_id < first OR page_id IS NULL")
    revisit = revisit.select(F.col("page_id").alias("r_id"), F.col("sha1").alias("r_sha1"), "first", "first_url").distinct()
    return base.join(revisit, base["page_id"].eqNullSafe(F.col("r_id")) & (F.col("sha1") == F.col("r_sha1")), "left").select("page_id", "url", "payload", "n", "sha1", F.col("first").alias("refers_to"), F.col("first_url").alias("refers_url"))


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    cuts = [F.substring(h, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """Header and block of one record; null fields are left out. The blank lines after it are the writer's separator."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))).otherwise(F.lit("")) for k, v in fields]
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), *lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def write_warc(pages: DataFrame, path: str) -> None:
    """Write a request, a response or revisit, and a metadata record for every row of pages (page_id, url, html).

    The records of a row follow each other and refer to the response through WARC-Concurrent-To; a revisit names its
    original by WARC-Refers-To-Target-URI and -Date. Control characters of a URL are percent-encoded, since a header is
    one line. Null html is an empty payload; a null url has no WARC-Target-URI. Files are gzip-compressed; a task writes
    its rows where they are, FILE_CAPTURES at most to a file. Pages too large for that many to stay below FILE_BYTES are
    written apart, by classes of size, so no file holds much more than FILE_BYTES or one page.
    """
    caps = captures(pages)
    bound, largest = FILE_BYTES // FILE_CAPTURES, pages.agg(F.max(F.octet_length("html"))).head()[0] or 0
    low, mode = -1, "error"
    while low < max(largest, 1):
        part = caps if largest <= bound and low < 0 else caps.filter((F.col("n") > low) & (F.col("n") <= bound))
        _write(part, path, max(1, FILE_BYTES // bound), mode, low)
        low, bound, mode = bound, bound * 16, "append"


def _write(caps: DataFrame, path: str, most: int, mode: str, group: int) -> None:
    """Write captures of one size class, at most so many to a file. Rows are numbered within the class, so ids name it too."""

    def clean(uri: Column) -> Column:
        for c in "\r\n\t\x00":
            uri = F.replace(uri, F.lit(c), F.lit(f"%{ord(c):02X}"))
        return uri

    rows = caps.withColumns({"seq": F.monotonically_increasing_id(), "uri": clean(F.col("url")), "refers_uri": clean(F.col("refers_url"))})
    rid = _urn(F.lit("response"), F.lit(group), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("seq"))
    host_path = F.regexp_extract("uri", r"^.*?://[^/?#]*([^#]*)", 1)
    get = F.concat(F.lit("GET "), F.when(F.coalesce(host_path, F.lit("")) == "", F.lit("/")).otherwise(host_path), F.lit(f" HTTP/1.1{CRLF}{CRLF}"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    sha = F.concat(F.lit("sha1:"), F.col("sha1"))
    kind = F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    meta = F.concat(
        F.when(F.col("page_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("pageId: "), F.col("page_id").cast("string"), F.lit(CRLF))),
        F.lit("payloadBytes: "), F.col("n").cast("string"), F.lit(CRLF),
        F.when(F.col("refers_to").isNull(), F.lit("")).otherwise(F.concat(F.lit("refersToPage: "), F.col("refers_to").cast("string"), F.lit(CRLF))),
    )
    common = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.col("uri"))]
    side = [("WARC-Concurrent-To", F.col("rid")), *common]
    records = F.array(
        _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", _urn(F.lit("request"), F.col("rid"))), *side, ("Content-Type", F.lit("application/http; msgtype=request"))], get),
        _record(
            [("WARC-Type", F.col("kind")), ("WARC-Record-ID", F.col("rid")), *common, ("WARC-Payload-Digest", sha), ("WARC-Profile", F.when(F.col("kind") == "revisit", F.lit(PROFILE))), ("WARC-Refers-To-Target-URI", F.col("refers_uri")), ("WARC-Refers-To-Date", F.when(F.col("refers_uri").isNotNull(), F.lit(DATE))), ("Content-Type", F.lit("application/http; msgtype=response"))],
            F.when(F.col("kind") == "revisit", head).otherwise(F.concat(head, F.col("payload"))),
        ),
        _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _urn(F.lit("metadata"), F.col("rid"))), *side, ("Content-Type", F.lit("application/warc-fields"))], meta),
    )
    lines = rows.withColumns({"rid": rid, "kind": kind}).select(F.explode(records).alias("value"))
    lines.write.mode(mode).option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", 3 * most).text(path)


def parse_archive(data: bytes, kinds: frozenset[str]) -> Iterator[dict]:
    """The records of one archive, by their Content-Length; gzip members, one or many, are unpacked on the way."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data:
            unzip = zlib.decompressobj(31)
            parts.append(unzip.decompress(data))
            data = unzip.unused_data
        data = b"".join(parts)
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        head = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            head[k.strip().lower().decode()] = v.strip().decode("utf-8", "replace")
        start = end + 4
        at = start + int(head["content-length"])
        if head["warc-type"] in kinds:
            yield {"head": head, "block": memoryview(data)[start:at]}


def read_warc(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("request", "response", "revisit", "metadata")) -> DataFrame:
    """One row for each record of the wanted kinds: ids, digests, payload and fields (of warc-fields blocks).

    The payload of a response is its HTTP body; revisits have none. An empty folder gives an empty table. Spark packs
    files into partitions by size, so a task holds about ``spark.sql.files.maxPartitionBytes`` of archives.
    """
    wanted = frozenset(kinds)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                size = 0
                for rec in parse_archive(content.as_py(), wanted):
                    rows.append(_row(rec["head"], bytes(rec["block"])))
                    size += len(rows[-1]["payload"] or b"")
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(parse, RECORD)


def _row(head: dict, block: bytes) -> dict:
    kind, payload, fields = head["warc-type"], None, {}
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
    elif kind == "metadata":
        fields = dict(line.split(": ", 1) for line in block.decode().split(CRLF) if ": " in line)
    return {
        "record_id": head.get("warc-record-id"), "type": kind, "concurrent_to": head.get("warc-concurrent-to"), "target_uri": head.get("warc-target-uri"),
        "digest": head.get("warc-payload-digest"), "payload": payload, "payload_bytes": None if payload is None else len(payload),
        "payload_sha1": None if payload is None else hashlib.sha1(payload).hexdigest(), "fields": list(fields.items()),
    }


_SCHEMA = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()), ("digest", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def assemble(spark: SparkSession, path: str) -> DataFrame:
    """One nested row per capture: url, response, request, metadata, joined through WARC-Concurrent-To.

    A capture without a request or metadata record keeps its row with a null there.
    """
    response = read_warc(spark, path, ("response", "revisit")).select("record_id", "target_uri", "type", "digest", "payload", "payload_bytes", "payload_sha1")
    request = read_warc(spark, path, ("request",)).select(F.col("concurrent_to").alias("q_to"), F.struct("record_id").alias("request"))
    meta = read_warc(spark, path, ("metadata",)).select(F.col("concurrent_to").alias("m_to"), F.struct("record_id", "fields").alias("metadata"))
    joined = response.join(request, F.col("record_id") == F.col("q_to"), "left").join(meta, F.col("record_id") == F.col("m_to"), "left")
    return joined.select(F.col("target_uri").alias("url"), F.struct("record_id", "type", "digest", "payload", "payload_bytes", "payload_sha1").alias("response"), "request", "metadata")


def digests(assembled: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of assembled captures.

    Figures of a response come from the payload that was read; those of a revisit from its digest and metadata.
    """
    field = lambda k: F.col("metadata.fields")[k]
    return assembled.select(
        field("pageId").cast("long").alias("page_id"),
        F.coalesce(F.col("response.payload_bytes"), field("payloadBytes").cast("long")).alias("payload_bytes"),
        F.coalesce(F.col("response.payload_sha1"), F.substring_index("response.digest", ":", -1)).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        field("refersToPage").cast("long").alias("refers_to"),
    )


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS sha FROM p),
f AS (SELECT sha, n, max(page_id) AS first FROM d WHERE n >= 1000 GROUP BY sha, n)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.sha AS payload_digest,
  CASE WHEN f.first IS NOT NULL AND (d.page_id < f.first OR d.page_id IS NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first IS NOT NULL AND (d.page_id < f.first OR d.page_id IS NULL) THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.sha = f.sha AND d.n = f.n
"""

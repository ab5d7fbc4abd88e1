"""WARC archives with revisit records for repeated payloads.

Only headers (page id, payload digest and length) are shuffled by digest; each digest that repeats
gets one original, the response with the largest page_id, found by a partial aggregate so
that a payload a third of all pages share does not gather anywhere. The decisions return to the pages by page id,
and records with fresh headers are written by Spark's text writer, one gzip file a task (and per
``records_per_file``). Reading streams the files through Spark's text reader, cut at record marks and put together by
Content-Length, so a task holds a record and not a file, and joins revisits to
their original responses by record id; the join's hot keys are left to the skew join, whose
inputs are tables in the shared folder.

Defined results: null html is an empty payload; line breaks in a URL become spaces; a null
page_id counts as smaller than any other; rows that equal their original's page_id and payload are
all responses.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import fresh_path, stored

BATCH = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.sha1(F.concat_ws("|", page_id.cast("string"), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def with_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, url, html, digest, n_bytes, and for revisits original (page_id) and original_url."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("n_bytes", F.octet_length("html").cast("long"))
    heads = pages.where(F.col("n_bytes") >= min_bytes).select("page_id", "url", "digest")
    best = heads.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    originals = stored(best.select("digest", F.col("best.page_id").alias("original"), F.col("best.url").alias("original_url")), "warc-originals")
    again = heads.join(originals, "digest").where("original > page_id or (page_id is null and original is not null)")
    again = again.groupBy(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest")).agg(F.max("original").alias("original"), F.max("original_url").alias("original_url"))
    return pages.join(again, F.expr("page_id <=> r_page and digest = r_digest"), "left").drop("r_page", "r_digest")


def write_warc(pages: DataFrame, path: str, min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 5000) -> None:
    """One record a page: a response, or a revisit of a response with the same payload."""
    df = with_revisits(pages, min_bytes)
    revisit = F.col("original").isNotNull()
    url = lambda c: F.regexp_replace(c, r"[\r\n]+", " ")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), _record_id(F.col("page_id"), F.col("digest")),
        F.lit("\r\nWARC-Target-URI: "), url("url"),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), _record_id(F.col("original"), F.col("digest")), F.lit("\r\nWARC-Refers-To-Target-URI: "), url("original_url"), F.lit(f"\r\nWARC-Profile: {PROFILE}"))).otherwise(F.lit("")),
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("\r\nX-Page-Id: "), F.col("page_id").cast("string"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    record = F.concat(head, block, F.lit("\r\n"))  # the writer's line separator ends the record
    df.select(record.alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


MARK = b"WARC/1."  # starts a record; pieces of a file between marks are the rows that the reader hands on


def records(pieces: Iterable[tuple[str, bytes]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named header fields (lower case) and block of each record, from (file, piece between marks) in order.

    A record goes on over marks inside it, up to its Content-Length; a task holds one record at a time.
    """
    parts, size, need, fields, start, at = [], 0, None, {}, 0, None
    for file, piece in pieces:
        if parts and file != at:
            break
        if not parts and not piece.strip():  # what stands before a file's first mark
            at = file
            continue
        more = [MARK, piece] if parts else [piece]
        parts, size, at = parts + more, size + sum(map(len, more)), file
        if need is None:
            data = b"".join(parts)
            start = data.find(b"\r\n\r\n") + 4
            if start < 4:
                continue
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[: start - 4].decode("utf-8", "replace").split("\r\n")[1:])}
            if "content-length" not in fields or "warc-type" not in fields:
                raise ValueError(f"no WARC record in {file}: {data[:40]!r}")
            need = start + int(fields["content-length"])
        if size >= need:
            data = b"".join(parts)
            yield fields, data[start:need]
            parts, size, need = [], 0, None
    if parts:
        raise ValueError(f"a record of {at} ends before its Content-Length: {parts[0][:40]!r}")


PARSED = "page_id long, record_id string, record_type string, target_uri string, payload_digest string, refers_to_id string, payload binary, payload_bytes long, checked boolean"


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row a record. payload and payload_bytes are null for revisits; checked: the digest of the payload read is the header's."""

    names, kinds = [x.split(" ")[0] for x in PARSED.split(", ")], (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.bool_())
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for f, block in records((file.as_py(), piece.as_py()) for b in batches for file, piece in zip(b.column(0), b.column(1))):
            kind, digest, body = f["warc-type"], f.get("warc-payload-digest", "").removeprefix("sha1:"), None
            if kind == "response":
                body = block[block.index(b"\r\n\r\n") + 4 :]
            page = f.get("x-page-id")
            rows.append((int(page) if page else None, f["warc-record-id"], kind, f.get("warc-target-uri"), digest, f.get("warc-refers-to"), body if payloads else None, None if body is None else len(body), None if body is None else hashlib.sha1(body).hexdigest() == digest))
            held += len(body) if payloads and body else 0
            if len(rows) >= 4096 or held >= BATCH:
                yield table(rows)
                rows, held = [], 0
        if rows:
            yield table(rows)

    pieces = spark.read.option("lineSep", MARK.decode()).text(path)
    return pieces.select(F.col("_metadata.file_name").alias("file"), F.col("value").cast("binary").alias("piece")).mapInArrow(run, PARSED)


def resolved(parsed: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (page_id): revisits take the length of the response they refer to."""
    index = stored(parsed.drop("payload", "target_uri"), "warc-index")
    responses = index.where("record_type = 'response'")
    named = stored(responses.groupBy("record_id").agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("bytes"), F.max("payload_digest").alias("digest")).withColumnRenamed("record_id", "refers_to_id"), "warc-responses")
    revisits = index.where("record_type = 'revisit'").join(named, "refers_to_id", "left").where("digest is null or digest = payload_digest")
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "checked").unionByName(
        revisits.select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", F.col("digest").isNotNull().alias("checked"))
    )


def op1_warc(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return resolved(read_warc(spark, path, payloads=False)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
o AS (SELECT payload_digest AS d, max(page_id) AS original FROM h WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < original THEN original END AS refers_to
FROM h LEFT JOIN o ON h.payload_digest = o.d
"""

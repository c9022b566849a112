"""WARC archives of web pages, with revisit records for repeated payloads.

Archives are written and read by Spark's own text and binary file readers and writers, so that any
shared store works: a record is one value, and the line end that the writer puts after it is the
last of the two that end a record. Files are gzip streams of bounded record counts.

First, every page is written as a response. Reading these archives back gives a header row for each
record; header rows, not payloads, are shuffled by payload digest, and of each group of equal
payloads (of at least ``least`` bytes) the record of the largest page id is the original. Then the
archives are written anew with fresh headers: originals keep their payload, the others become
revisit records that name the original's record.

Defined results: a null html is an empty payload; a page with a null url has no target URI. Of rows
with equal page ids and payloads one row stands as original and the others revisit it. A null page
id stands before all others and refers to nothing. Extra columns are not archived.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themelift.llm.common import tidy
from themelift.sizing import lookup_join, scratch_dir, stage

RECORDS_A_FILE = 4096
DATE = "1970-01-01T00:00:00Z"  # the tables have no fetch times
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = (
    "record_id string, page_id long, url string, record_type string, payload_digest string, "
    "payload_bytes long, refers_to_record string"
)


def base32(hex_sha1: Column) -> Column:
    """Upper-case base32 of the hexadecimal digits of a SHA-1."""
    parts = [F.lpad(F.conv(F.substring(hex_sha1, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_name(page_id: Column, copy: Column) -> Column:
    """A record's URI: by page id, and by the row's own number where a page id is repeated."""
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), copy.cast("string"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")))


def _record(kind: Column, body: Column) -> Column:
    """A whole record but its last line end. Columns: as in HEADERS, of the record to write."""
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", F.col("record_id")),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]", "")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Refers-To", F.col("refers_to_record")),
        _line("WARC-Profile", F.when(F.col("refers_to_record").isNotNull(), F.lit(PROFILE))),
        _line("X-Payload-Length", F.col("payload_bytes")),
        _line("X-Page-Id", F.col("page_id")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
    )
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        _line("Content-Length", F.when(F.col("refers_to_record").isNull(), F.col("payload_bytes"))),
        F.lit("\r\n"),
    )
    size = F.octet_length(http) + F.octet_length(body)
    return F.concat(head, _line("Content-Length", size), F.lit("\r\n"), http, body, F.lit("\r\n"))


def _write(records: DataFrame, path: str) -> None:
    (
        records.write.option("lineSep", "\r\n")
        .option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED")
        .option("maxRecordsPerFile", RECORDS_A_FILE)
        .text(path)
    )


def write_responses(pages: DataFrame, path: str) -> None:
    """A response record for each row of page_id, url and html."""
    digest = base32(F.sha1(F.col("html")))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
        F.monotonically_increasing_id().alias("copy"),
    )
    rows = rows.select(
        "page_id", "url", "html",
        record_name(F.col("page_id"), F.col("copy")).alias("record_id"),
        digest.alias("payload_digest"),
        F.octet_length("html").cast("long").alias("payload_bytes"),
        F.lit(None).cast("string").alias("refers_to_record"),
    )
    _write(rows.select(_record(F.lit("response"), F.col("html"))), path)


def records(archive: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record of an archive, one record at a time; the payload is what
    follows a record's HTTP headers."""
    while version := archive.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError("no WARC record here")
        fields: dict[str, str] = {}
        while line := archive.readline().rstrip(b"\r\n"):
            name, _, value = line.decode().partition(": ")
            fields[name] = value
        body = archive.read(int(fields["Content-Length"]))
        archive.read(4)
        yield fields, body[body.index(b"\r\n\r\n") + 4 :]


def unpacked(content: pa.BinaryScalar) -> io.BufferedReader:
    return io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer())), 1 << 20)


def read_archives(spark, path: str, payloads: bool = False) -> DataFrame:
    """A header row for each record, and its payload if asked for."""
    files = spark.read.format("binaryFile").load(path).select("content")
    names = [f.split(" ")[0] for f in HEADERS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, bodies, size = [], [], 0
                for fields, payload in records(unpacked(content)):
                    page = fields.get("X-Page-Id")
                    rows.append((
                        fields["WARC-Record-ID"], None if page is None else int(page), fields.get("WARC-Target-URI"),
                        fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                        int(fields["X-Payload-Length"]), fields.get("WARC-Refers-To"),
                    ))
                    if payloads:
                        bodies.append(payload)
                        size += len(payload)
                    if size > 8 << 20 or len(rows) >= 10_000:
                        yield _batch(rows, bodies, payloads)
                        rows, bodies, size = [], [], 0
                if rows:
                    yield _batch(rows, bodies, payloads)

    def _batch(rows: list, bodies: list, payloads: bool) -> pa.RecordBatch:
        kinds = [pa.int64() if " long" in f else pa.string() for f in HEADERS.split(", ")]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        if payloads:
            columns.append(pa.array(bodies, pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names + ["payload"] * payloads)

    return files.mapInArrow(tidy(run), HEADERS + ", payload binary" * payloads)


def originals(headers: DataFrame, least: int = 0) -> DataFrame:
    """record_id and refers_to_record of the records that become revisits: of equal payloads (same
    digest and length) all but that with the largest page id."""
    rows = headers.where(F.col("payload_bytes") >= least)
    rank = F.struct(F.coalesce(F.col("page_id"), F.lit(-(1 << 63))).alias("page_id"), F.col("record_id").alias("record_id"))
    groups = rows.groupBy("payload_digest", "payload_bytes").agg(F.count(F.lit(1)).alias("n"), F.max(rank).alias("last"))
    groups = stage(groups.where("n > 1").select("payload_digest", "payload_bytes", F.col("last.record_id").alias("refers_to_record")), "originals")
    found = lookup_join(rows.select("record_id", "payload_digest", "payload_bytes"), groups, ["payload_digest", "payload_bytes"])
    return found.where("record_id <> refers_to_record").select("record_id", "refers_to_record")


def archive(pages: DataFrame, least: int = 0) -> str:
    """Write the pages as archives without repeated payloads; the folder of the archives."""
    spark = pages.sparkSession
    raw, out = scratch_dir(spark, "warc-raw"), scratch_dir(spark, "warc")
    write_responses(pages, raw)
    revisits = stage(originals(stage(read_archives(spark, raw), "headers"), least), "revisits")
    whole = read_archives(spark, raw, payloads=True).drop("refers_to_record", "record_type")
    rows = lookup_join(whole, revisits, ["record_id"], "left")
    revisit = F.col("refers_to_record").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    _write(rows.select(_record(F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), body)), out)
    return out


def page_records(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (the original's page id)
    of every record of these archives."""
    headers = read_archives(spark, path)
    page = F.regexp_extract("refers_to_record", "^<urn:x-page:(-?[0-9]+):", 1)
    return headers.select(
        "page_id", "payload_bytes", "payload_digest", "record_type",
        F.when(page != "", page.cast("long")).alias("refers_to"),
        "url",
    )

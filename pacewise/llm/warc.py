"""Content-addressed WARC archive.

Two tables in a shared folder make an archive: ``payloads`` holds every distinct payload once under its SHA-256, and
``records`` the exact header block of each record with that key. Records come back by a join of the two; digests are
verified on every read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch

#: Equal payloads of at least so many bytes are stored as one response and revisits of it.
LEAST_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 hex digits are eight groups of 20 bits, four characters each."""
    digits = F.sha1(data)
    out = []
    for k in range(8):
        v = F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def _clean(text: Column) -> Column:
    """A header value: line ends would end the header."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]+", " ")


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write one WARC record for each row of ``pages`` (page_id, url, html) to the archive at ``path``.

    The payload is the html in UTF-8, empty if null. Of the records with an equal payload of ``least_bytes`` or more
    that with the smallest page_id is the response and the others revisit it; shorter payloads are all responses.
    Records that also share the page_id are alike: each of the smallest page_id is a response. Null page_ids come last.
    Other columns are not kept. An empty table makes an empty archive.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    meta = rows.select("page_id", "url", "sha256", F.octet_length("payload").cast("bigint").alias("n"), base32_sha1(F.col("payload")).alias("sha1"))
    # null ids sort last, so that a record without an id is a response only among its like
    firsts = meta.where(F.col("n") >= least_bytes).groupBy("sha256").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"))).alias("first"))
    both = meta.join(firsts, "sha256", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first.id").eqNullSafe(F.col("page_id"))
    crlf = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("n").cast("string"), F.lit(crlf * 2))
    length = F.length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n"))
    head = F.concat(
        F.lit(f"WARC/1.1{crlf}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{crlf}WARC-Record-ID: "), _id(F.col("page_id")), F.lit(f"{crlf}WARC-Date: {DATE}{crlf}WARC-Target-URI: "), _clean(F.col("url")),
        F.when(revisit, F.concat(F.lit(f"{crlf}WARC-Profile: {PROFILE}{crlf}WARC-Refers-To: "), _id(F.col("first.id")))).otherwise(F.lit("")),
        F.lit(f"{crlf}WARC-Payload-Digest: sha1:"), F.col("sha1"), F.lit(f"{crlf}Content-Type: application/http;msgtype=response{crlf}Content-Length: "), length.cast("string"), F.lit(crlf * 2),
        http,
    )
    both.select("sha256", head.cast("binary").alias("header")).write.parquet(f"{path}/records", compression="zstd")
    # one of equal payloads, chosen before the shuffle too, so that copies don't travel
    rows.select("sha256", "payload").groupBy("sha256").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads", compression="zstd")


def _field(name: str) -> Column:
    """A header's value. Only a line feed ends a line here: a URL may hold other characters that end lines elsewhere."""
    return F.nullif(F.regexp_extract(F.decode("header", "UTF-8"), rf"(?md)^{name}: ([^\r\n]*)", 1), F.lit(""))


def read(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """The records of the archive: page_id, url, payload_bytes, payload_digest, record_type and refers_to.

    Each payload's SHA-256 is checked against its key and its SHA-1 against the record's header; a difference fails
    the read. With ``whole`` also ``payload`` and ``record``, the bytes of the record as in a WARC file (a revisit has
    none of its payload).
    """
    sound = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.lit("payload doesn't match its digest")).cast("binary"))
    store = spark.read.parquet(f"{path}/payloads").withColumn("payload", sound)
    store = store.select("sha256", F.octet_length("payload").cast("bigint").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("digest"), *(["payload"] if whole else []))
    both = spark.read.parquet(f"{path}/records").join(store, "sha256")
    told = F.substring(_field("WARC-Payload-Digest"), 6, 32)
    out = both.select(
        F.expr("try_cast(regexp_extract(decode(header, 'UTF-8'), '(?md)^WARC-Record-ID: <urn:page:([^>]*)>', 1) as bigint)").alias("page_id"), _field("WARC-Target-URI").alias("url"), "payload_bytes",
        F.when(told == F.col("digest"), told).otherwise(F.raise_error(F.lit("record doesn't match its payload")).cast("string")).alias("payload_digest"), _field("WARC-Type").alias("record_type"),
        F.expr("try_cast(nullif(regexp_extract(decode(header, 'UTF-8'), '(?md)^WARC-Refers-To: <urn:page:([^>]*)>', 1), '') as bigint)").alias("refers_to"),
        *([F.col("payload"), F.col("header")] if whole else []),
    )
    if whole:
        end = F.lit("\r\n\r\n").cast("binary")
        out = out.withColumn("record", F.when(F.col("record_type") == "revisit", F.concat("header", end)).otherwise(F.concat("header", "payload", end))).drop("header")
    return out


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the records back."""
    path = scratch(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

"""WARC writing with revisit resolution.

Headers (digest, id) are shuffled by payload digest; of the records that share a payload
one stays a ``response`` and the others are joined to it and written as ``revisit``
records, which carry fresh headers and no payload.  Archives are written by Spark's text
sink (a record is one value, the record end CRLF CRLF is the line separator) and read back
by its text source, so neither side holds an archive in memory.

A group of equal payloads may hold most rows: headers are combined per (digest, salt)
before the shuffle, and pages meet them by (digest, salt).

Defined results: a null payload is an empty one; a null id is smaller than any other and
keeps its record; repeated rows of the id that stays are all responses; a payload that
contains the record start is stored as base64; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CRLF = "\r\n"
RECORD_END = CRLF * 2
#: Fixed text of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_START = f"{VERSION}{CRLF}WARC-Type: "
SALTS = 32


def resolve(pages: DataFrame, min_bytes: int = 1000, salts: int = SALTS) -> DataFrame:
    """``pages`` (page_id, url, html) with payload_bytes, payload_digest, refers_to, refers_url.

    ``refers_to`` is set for the records that revisit another; payloads under
    ``min_bytes`` never do.
    """
    rows = pages.select(
        F.col("page_id"), F.col("url"), F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    rows = rows.withColumns({
        "payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload"),
        "salt": F.pmod(F.xxhash64("page_id"), F.lit(salts))})
    heads = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "salt").agg(
        F.max(F.struct("page_id", "url")).alias("kept"), F.count("*").alias("n"))
    same = Window.partitionBy("payload_digest")
    groups = heads.withColumns({"kept": F.max("kept").over(same), "n": F.sum("n").over(same)}) \
        .where(F.col("n") > 1).select("payload_digest", "salt", "kept")
    joined = rows.join(groups, ["payload_digest", "salt"], "left")
    revisit = F.col("kept").isNotNull() & ~F.col("kept.page_id").eqNullSafe(F.col("page_id"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, F.col("kept.page_id")).alias("refers_to"),
        F.when(revisit, F.col("kept.url")).alias("refers_url"))


def _field(name: str, value) -> F.Column:
    """One header line, empty when the value is null; line breaks in it are escaped."""
    text = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), text, F.lit(CRLF)), F.lit(""))


def write_archives(resolved: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one WARC record per row of ``resolve`` as gzip archives below ``path``."""
    revisit = F.col("refers_to").isNotNull()
    clash = F.contains(F.col("payload"), F.lit(VERSION + CRLF))
    body = F.when(revisit, F.lit("")).when(clash, F.base64(F.col("payload").cast("binary"))) \
        .otherwise(F.col("payload"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
        F.when(clash & ~revisit, F.lit(f"Content-Transfer-Encoding: base64{CRLF}")).otherwise(F.lit("")),
        F.lit(CRLF))
    rows = resolved.withColumns({"body": body, "http": http})
    head = F.concat(
        F.lit(RECORD_START), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), F.lit(CRLF),
        _field("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        _field("WARC-Date", F.lit(date)), _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _field("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        _field("WARC-Refers-To-Target-URI", F.col("refers_url")),
        _field("X-Payload-Length", F.col("payload_bytes")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        _field("Content-Length", F.octet_length("http") + F.octet_length("body")))
    rows.select(F.concat(head, F.lit(CRLF), F.col("http"), F.col("body")).alias("value")) \
        .write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Read archives written by ``write_archives``.

    Columns page_id, url, record_type, refers_to, payload (null for revisits),
    payload_bytes, payload_digest (of responses recomputed from the payload, of revisits
    as their headers state) and ``intact``: lengths and digest agree with the headers.
    """
    rows = spark.read.option("lineSep", RECORD_START).text(path).where("value != ''")
    cut = F.instr("value", RECORD_END)
    rows = rows.select(F.substring("value", F.lit(1), cut + 1).alias("head"),
                       F.substring("value", cut + 4, F.length("value")).alias("block"))

    def field(name):
        return F.nullif(F.regexp_extract("head", rf"(?:^|\n){name}: ([^\r]*)\r", 1), F.lit(""))
    rows = rows.select(
        F.substring_index("head", CRLF, 1).alias("record_type"),
        F.regexp_extract("head", r"WARC-Record-ID: <urn:page:(-?\d+)>", 1).try_cast("long").alias("page_id"),
        F.regexp_extract("head", r"WARC-Refers-To: <urn:page:(-?\d+)>", 1).try_cast("long").alias("refers_to"),
        field("WARC-Target-URI").alias("url"), field("X-Payload-Length").cast("long").alias("stated_bytes"),
        F.replace(field("WARC-Payload-Digest"), F.lit("sha1:"), F.lit("")).alias("stated_digest"),
        field("Content-Length").cast("long").alias("block_bytes"),
        F.expr("left(block, length(block) - 4)").alias("block"))
    at = F.instr("block", RECORD_END)
    rows = rows.withColumns({
        "http": F.substring("block", F.lit(1), at + 1),
        "raw": F.when(F.col("record_type") == "response", F.substring("block", at + 4, F.length("block")))})
    rows = rows.withColumn("payload", F.when(
        F.contains("http", F.lit("Content-Transfer-Encoding: base64")), F.unbase64("raw").cast("string")).otherwise(F.col("raw")))
    size = F.coalesce(F.octet_length("payload").cast("long"), F.col("stated_bytes"))
    digest = F.coalesce(F.sha1("payload"), F.col("stated_digest"))
    return rows.select(
        "page_id", "url", "record_type", "refers_to", "payload", size.alias("payload_bytes"),
        digest.alias("payload_digest"),
        ((size == F.col("stated_bytes")) & (digest == F.col("stated_digest"))
         & (F.octet_length("block") == F.col("block_bytes"))).alias("intact"))

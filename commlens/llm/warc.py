"""Content-addressed WARC archive. DataFrame functions only.

An archive is two Parquet tables. `payloads` holds each distinct payload once, under its SHA-256. `records` holds for each
page the exact header block of its WARC record, from "WARC/1.1" to the end of the HTTP head, and the SHA-256 of its payload.
A join on the digest gives the records back byte by byte.

Of the records with equal payloads of at least min_revisit bytes, those with the largest page_id are responses and the
others are revisits, which refer to it and carry no payload; smaller payloads give responses only. A null html is the empty
payload. A null page_id is smaller than any other and reads back as null. Rows that repeat the largest page_id of a payload are
all responses; the payload is still stored once. Line breaks and spaces in a url are percent-encoded, so that no url can add
a header; a null url becomes urn:page:<page_id>. An empty table gives an archive without records. Every read checks each
payload against its key and against the SHA-1 in the headers, and fails on a difference.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WARC_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: eight times five hex digits become four symbols."""
    digest = F.sha1(payload)
    symbols = []
    for part in range(8):
        bits = F.conv(F.substring(digest, 5 * part + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            symbols.append(F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*symbols)


def _payload() -> Column:
    return F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))


def _lines(*lines: Column) -> Column:
    """Lines with CRLF each; a null line is left out."""
    return F.concat(*(F.when(line.isNull(), F.lit("")).otherwise(F.concat(line, F.lit("\r\n"))) for line in lines))


def write_archive(pages: DataFrame, folder: str, min_revisit: int = 0) -> None:
    """Write pages(page_id, url, html) as an archive into folder."""
    spark = pages.sparkSession
    payload = pages.select("page_id", _payload().alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    (
        payload.groupBy("sha256")
        .agg(F.max("page_id").alias("response_id"), F.first("payload").alias("payload"))
        .write.parquet(f"{folder}/payloads")
    )
    first = spark.read.parquet(f"{folder}/payloads").select("sha256", "response_id")
    rows = pages.select(
        "page_id",
        F.translate(F.col("url"), "\r\n\t ", "\u0001\u0002\u0003\u0004").alias("url"),
        F.sha2(_payload(), 256).alias("sha256"),
        base32_sha1(_payload()).alias("sha1"),
        F.octet_length(_payload()).cast("long").alias("n_bytes"),
    ).join(first, "sha256")
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    url = F.col("url")
    for mark, code in zip("\u0001\u0002\u0003\u0004", ("%0D", "%0A", "%09", "%20"), strict=True):
        url = F.replace(url, F.lit(mark), F.lit(code))
    uri = F.coalesce(url, F.concat(F.lit("urn:page:"), name))
    revisit = (F.col("n_bytes") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    http = _lines(
        F.lit("HTTP/1.1 200 OK"),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.col("n_bytes").cast("string")),
        F.lit(""),
    )
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes"))
    head = _lines(
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), name, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.lit(f"WARC-Date: {WARC_DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("response_id").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
        F.lit(""),
    )
    rows.select("sha256", F.encode(F.concat(head, http), "UTF-8").alias("header")).write.parquet(f"{folder}/records")


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """sha256, payload, payload_bytes, payload_digest (SHA-1), of payloads that match their keys."""
    rows = spark.read.parquet(f"{folder}/payloads").select("sha256", "payload")
    checked = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("sha256")).otherwise(
        F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.col("sha256"))).cast("string")
    )
    return rows.select(
        checked.alias("sha256"),
        "payload",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
    )


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """The records' header blocks and what they say."""
    text = F.decode("header", "UTF-8")

    def said(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(text, f"\r\n{pattern}\r\n", 1), F.lit(""))

    return spark.read.parquet(f"{folder}/records").select(
        "sha256",
        "header",
        said("WARC-Record-ID: <urn:page:([^>]*)>").try_cast("long").alias("page_id"),
        said("WARC-Type: ([a-z]+)").alias("record_type"),
        said("WARC-Target-URI: ([^\r]*)").alias("url"),
        said("WARC-Payload-Digest: sha1:([A-Z2-7]+)").alias("header_digest"),
        said("WARC-Refers-To: <urn:page:([^>]*)>").try_cast("long").alias("refers_to"),
    )


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to; payloads themselves are not moved."""
    content = read_payloads(spark, folder).select("sha256", "payload_bytes", "payload_digest")
    agreed = F.when(F.col("payload_digest") == F.col("header_digest"), F.col("payload_digest")).otherwise(
        F.raise_error(F.lit("header and payload digests differ")).cast("string")
    )
    return (
        read_headers(spark, folder)
        .join(content, "sha256")
        .select("page_id", "url", "payload_bytes", agreed.alias("payload_digest"), "record_type", "refers_to")
    )


def records(spark: SparkSession, folder: str) -> DataFrame:
    """page_id and the whole WARC record in bytes: header block, payload of a response, closing line breaks."""
    payload = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return (
        read_headers(spark, folder)
        .join(read_payloads(spark, folder).select("sha256", "payload"), "sha256")
        .select("page_id", "record_type", F.concat("header", payload, F.lit(b"\r\n\r\n")).alias("record"))
    )


def write_warc_files(spark: SparkSession, folder: str, target: str) -> None:
    """The records as gzip-compressed WARC text files in target (payloads are UTF-8, so text files hold their exact bytes)."""
    text = records(spark, folder).select(F.decode(F.expr("substring(record, 1, length(record) - 4)"), "UTF-8"))
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(target)


def archived(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Write an archive of pages in the shared folder and read it back."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/llm-warc-{uuid.uuid4().hex}"
    write_archive(pages, folder, min_revisit)
    return read_archive(spark, folder)

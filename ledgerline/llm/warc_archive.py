"""Content-addressed WARC archive.

Two tables in one folder: ``payloads`` holds each distinct payload once under its SHA-256, ``headers`` holds every
record's exact header block and the digest it refers to. Reading verifies the digests and joins the two again; what
comes back is the records byte for byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm._common import many_to_one, written

CRLF = "\r\n"
#: Equal payloads of at least so many bytes are stored as one response and revisits.
REVISIT_FROM = 100


def _header(kind: Column, record: Column, url: Column, digest: Column, length: Column, refers: Column, date: str) -> Column:
    profile = F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}")
    line = F.regexp_replace(url, "[\r\n]", "%0A")  # a line break would start another header line
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"), record, F.lit(f">{CRLF}WARC-Date: {date}{CRLF}"),
        F.when(url.isNotNull(), F.concat(F.lit("WARC-Target-URI: "), line, F.lit(CRLF))).otherwise(F.lit("")),
        F.lit("WARC-Payload-Digest: sha256:"), digest, F.lit(CRLF),
        F.when(kind == "revisit", F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.coalesce(refers, F.lit("")), F.lit(f">{CRLF}"), profile)).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/octet-stream{CRLF}Content-Length: "), F.when(kind == "revisit", F.lit("0")).otherwise(length.cast("string")), F.lit(f"{CRLF}{CRLF}"),
    )


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes one WARC record per row under ``path`` (headers and payloads as Parquet).

    Of records with equal payloads of at least ``REVISIT_FROM`` bytes the one with the smallest id is the response and
    the others revisit it; smaller payloads are responses all. A null body is an empty payload. A null id never is the
    smallest unless all are null (then all are responses); rows that repeat the smallest id are responses too. Only
    digests are shuffled to choose responses; payloads are collapsed to one per digest and task before they are shuffled; a digest that
    very many records have is dealt into several tasks wherever records meet it.
    """
    payload = F.coalesce(F.encode(F.col(body_col).cast("string"), "UTF-8"), F.lit(b""))
    given = pages.select(F.col(id_col).cast("string").alias("record"), F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    given = given.select("record", "id", "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("length"), "payload")
    listed = written(given.drop("payload"), "warc-records")
    first = listed.groupBy("digest").agg(F.min("id").alias("first")).withColumnRenamed("digest", "d")
    records = many_to_one(listed, "digest", first, "d")
    revisit = (F.col("length") >= REVISIT_FROM) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    header = _header(kind, F.coalesce(F.col("record"), F.lit("")), F.col("url"), F.col("digest"), F.col("length"), F.col("first").cast("string"), date)
    records.select(F.encode(header, "UTF-8").alias("header"), "digest").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/headers")
    given.groupBy("digest").agg(F.first("payload").alias("payload")).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records: record_id (string, null where it was), url, record_type, refers_to, payload_digest, payload_bytes, header and payload.

    Header fields are parsed from the stored header bytes. ``payload`` is the full payload, also of a revisit; a payload
    that doesn't have the digest it is stored under raises an error.
    """
    head = F.decode(F.col("header"), "UTF-8")
    field = lambda name, of: F.nullif(F.regexp_extract(head, f"(?md)^{name}: {of}\r$", 1), F.lit(""))
    stored = spark.read.parquet(f"{path}/headers")
    headers = stored.select(
        field("WARC-Record-ID", "<urn:page:(.*)>").alias("record_id"), field("WARC-Target-URI", "(.*)").alias("url"), field("WARC-Type", "(.*)").alias("record_type"),
        field("WARC-Refers-To", "<urn:page:(.*)>").alias("refers_to"), field("WARC-Payload-Digest", "sha256:(.*)").alias("payload_digest"), "header",
    )
    payloads = spark.read.parquet(f"{path}/payloads")
    checked = payloads.select(F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("digest")))).alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload")
    return many_to_one(headers, "payload_digest", checked, "digest", stored.withColumnRenamed("digest", "payload_digest")).drop("digest")


def record_bytes(records: DataFrame) -> DataFrame:
    """record_id and the exact bytes of each WARC record: header, block (none in a revisit) and two line ends."""
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.select("record_id", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))

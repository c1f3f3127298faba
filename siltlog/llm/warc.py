"""Content-addressed web archive.

Two tables make an archive: ``payloads`` holds each payload's bytes once, under
its SHA-256; ``headers`` holds the exact header text of every record and the
address of its payload. Records are read back by joining the two, and each
payload is hashed again when it is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siltlog.session import working_path

# The base32 alphabet and the WARC line ends.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: each 20 bits of the digest are four letters."""
    digest = F.sha1(payload)
    letters = []
    for k in range(8):
        bits = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1
            letters.append(F.substring(F.lit(BASE32), at, F.lit(1)))
    return F.concat(*letters)


@dataclass(frozen=True)
class Archive:
    spark: SparkSession
    path: str

    @property
    def headers(self) -> DataFrame:
        """``page_id, header, address``: one row per record."""
        return self.spark.read.schema("page_id long, header string, address string").parquet(f"{self.path}/headers")

    @property
    def payloads(self) -> DataFrame:
        """``address, payload``: one row per distinct payload."""
        return self.spark.read.schema("address string, payload binary").parquet(f"{self.path}/payloads")


def _header(kind: str) -> Column:
    """The header text of a record, ended by an empty line."""
    lines = [
        ("WARC-Type: ", F.lit(kind)),
        ("WARC-Record-ID: ", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        ("WARC-Date: ", F.lit(ARCHIVE_DATE)),
        ("WARC-Target-URI: ", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")),
        ("WARC-Payload-Digest: ", F.concat(F.lit("sha1:"), F.col("sha1"))),
    ]
    if kind == "revisit":
        lines.append(("WARC-Profile: ", F.lit(REVISIT_PROFILE)))
        lines.append(("WARC-Refers-To: ", F.concat(F.lit("<urn:page:"), F.col("newest").cast("string"), F.lit(">"))))
    length = F.lit("0") if kind == "revisit" else F.col("bytes").cast("string")
    lines.append(("Content-Length: ", length))
    parts = [F.lit(f"WARC/1.1{CRLF}")]
    for name, value in lines:
        parts += [F.lit(name), value, F.lit(CRLF)]
    return F.concat(*parts, F.lit(CRLF))


def write_archive(pages: DataFrame, path: str, shared_from: int = 0) -> Archive:
    """Write one record per row of ``page_id, url, html``; other columns are ignored.

    A null html is an empty payload. Of the records with equal payloads of at
    least ``shared_from`` bytes the one with the largest page_id is the response
    and the others revisit it; every smaller payload is a response of its own.
    Rows that repeat the largest page_id are all responses, their bytes are
    stored once all the same. A null page_id is smaller than any other. Payloads
    never pass through a shuffle but for the one row per digest that is kept.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    records = pages.select("page_id", "url", payload.alias("payload")).select(
        "*",
        F.sha2("payload", 256).alias("address"),
        base32_sha1(F.col("payload")).alias("sha1"),
        F.octet_length("payload").cast("long").alias("bytes"),
    )
    light = records.drop("payload")
    newest = light.groupBy("address").agg(F.max("page_id").alias("newest"), F.count("*").alias("copies"))
    # A digest that one row has alone needs no partner; a hot digest is split by the adaptive join.
    linked = light.join(newest, "address")
    is_response = (F.col("bytes") < shared_from) | F.col("page_id").eqNullSafe(F.col("newest"))
    headers = linked.select(
        "page_id", F.when(is_response, _header("response")).otherwise(_header("revisit")).alias("header"), "address"
    )
    headers.write.parquet(f"{path}/headers")
    records.select("address", "payload").dropDuplicates(["address"]).write.parquet(f"{path}/payloads")
    return Archive(spark, path)


def _field(name: str) -> Column:
    value = F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(value != "", value)


def read_archive(archive: Archive, with_records: bool = False) -> DataFrame:
    """One row per record, from its header and the payload its address names.

    ``record_type``, ``refers_to`` and the digest come out of the header text;
    ``payload_bytes`` and ``verified`` from the payload itself, which must hash
    to both its address and the header's digest. ``with_records`` adds
    ``record binary``, the record byte for byte, and ``payload``.
    """
    stored = archive.payloads.select(
        "address",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("sha1"),
        (F.sha2("payload", 256) == F.col("address")).alias("sound"),
        *(["payload"] if with_records else []),
    )
    read = archive.headers.join(stored, "address", "left").select(
        "page_id",
        "payload_bytes",
        F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        F.regexp_extract(_field("WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1).cast("long").alias("refers_to"),
        "header",
        "sha1",
        "sound",
        *(["payload"] if with_records else []),
    )
    verified = F.coalesce(F.col("sound") & (F.col("sha1") == F.col("payload_digest")), F.lit(False))
    out = read.withColumn("verified", verified).drop("sha1", "sound")
    if not with_records:
        return out.drop("header")
    head = F.encode("header", "UTF-8")
    tail = F.encode(F.lit(CRLF + CRLF), "UTF-8")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return out.withColumn("record", F.concat(head, body, tail)).drop("header")


def archived(pages: DataFrame, shared_from: int = 0) -> DataFrame:
    """Write ``pages`` as an archive in the shared folder and read it back."""
    path = working_path(pages.sparkSession, "archive")
    return read_archive(write_archive(pages, path, shared_from))

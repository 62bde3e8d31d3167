"""A content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256; record headers are stored separately, byte for
byte, with the digest of the payload they describe. Records are put together again by a join.
Copies are collapsed before the shuffle, so a payload that a third of all pages share travels once
for each task; on reading, its many headers meet one stored row in a sort-merge join, whose large
side adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.sources import workspace

DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture
BREAK = "\r\n"
BASE16 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"  # digits of radix 32 as conv() writes them
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # RFC 4648


def sha1_base32(payload: Column) -> Column:
    """SHA-1 as WARC writes it: 160 bits in four groups of eight base32 digits."""
    digest = F.sha1(payload)
    groups = [
        F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*groups), BASE16, BASE32)


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def keyed(pages: DataFrame) -> DataFrame:
    """Pages with payload and digests; a null html is an empty payload."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select("page_id", "url", payload.alias("payload")).select(
        "page_id", "url", "payload", F.sha2("payload", 256).alias("digest"),
        sha1_base32(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))


def _verified(digest: Column, agrees: Column) -> Column:
    """The digest, or an error if what it stands for does not agree."""
    return F.when(agrees, digest).otherwise(F.raise_error(F.concat(F.lit("digest does not hold: "), digest)))


def write(pages: DataFrame, folder: str, shared_from: int = 0) -> None:
    """Archive (page_id, url, html) rows under ``folder``: ``payloads`` and ``headers``.

    Among pages of equal payload of at least ``shared_from`` bytes the one with the largest id is
    the response and the others revisit it; shorter payloads are responses everywhere. Rows that
    repeat the largest id are responses all. Pages without an id revisit like others, and are
    responses if no page with that payload has an id. Empty tables make an empty archive; further
    columns are not stored. A digest is verified: two payloads under one SHA-256 that differ in
    SHA-1 or length stop the job.
    """
    rows = keyed(pages)
    proof = F.struct("sha1", "bytes")
    rows.groupBy("digest").agg(
        F.first("payload").alias("payload"), F.min(proof).alias("low"), F.max(proof).alias("high"),
    ).select(
        _verified(F.col("digest"), F.col("low") == F.col("high")).alias("digest"), "payload",
    ).write.option("compression", "zstd").parquet(f"{folder}/payloads")

    heads = rows.drop("payload")
    # Stored, so that the join has a shuffle of its own on either side and a hot payload can be split.
    owners = workspace.written(heads.groupBy("digest").agg(F.max("page_id").alias("owner")), "owners")
    owned = heads.join(owners, "digest")
    revisit = (F.col("bytes") >= shared_from) & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    header = F.concat(
        F.lit(f"WARC/1.1{BREAK}"), _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _urn(F.col("page_id"))),
        F.coalesce(_field("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")), F.lit("")),
        _field("WARC-Date", F.lit(DATE)), _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(
            _field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            _field("WARC-Refers-To", _urn(F.col("owner"))))).otherwise(""),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")), F.lit(BREAK))
    owned.select("page_id", header.alias("header"), "digest").write.option(
        "compression", "zstd").parquet(f"{folder}/headers")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Records of an archive: (page_id, header, payload, record).

    ``record`` is the record as a WARC file holds it; ``payload`` is the full payload, for revisits
    that of the record they refer to. Stored bytes that no longer hash to their digest stop the job.
    """
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads").select(
        _verified(F.col("digest"), F.sha2("payload", 256) == F.col("digest")).alias("digest"), "payload")
    headers = spark.read.schema("page_id long, header string, digest string").parquet(f"{folder}/headers")
    body = F.when(F.col("header").contains(f"WARC-Type: revisit{BREAK}"), F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return headers.join(payloads, "digest").select(
        "page_id", "header", "payload",
        F.concat(F.encode("header", "UTF-8"), body, F.encode(F.lit(BREAK * 2), "UTF-8")).alias("record"))


def described(records: DataFrame) -> DataFrame:
    """What the records say: type, the record referred to, and digest and length of the payload."""
    def field(name: str) -> Column:
        return F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)

    refers = F.regexp_extract(field("WARC-Refers-To"), r"^<urn:page:(-?[0-9]+)>$", 1)
    return records.select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
        sha1_base32(F.col("payload")).alias("payload_digest"), field("WARC-Type").alias("record_type"),
        F.when(refers != "", refers).cast("long").alias("refers_to"),
        F.octet_length("record").cast("long").alias("record_bytes"),
        field("WARC-Payload-Digest").alias("stated_digest"))

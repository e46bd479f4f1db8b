"""Content-addressed WARC archive: payload bytes once by strong digest, exact record headers separately.

``write_archive`` writes two tables under a folder: ``payloads`` (sha256, length, payload, response_id)
and ``headers`` (page_id, sha256, header).  ``read_archive`` joins them to whole records again and checks
the bytes against the digest, and ``parse_records`` takes a record apart by its own header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.session import new_dir

#: Fixed values of the WARC 1.1 format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
DATE = "1970-01-01T00:00:00Z"


def base32(hexadecimal: Column) -> Column:
    """Base32 of a SHA-1 in hexadecimal: each 5 hexadecimal digits are 4 of base32."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.lower(F.concat(*parts)), "0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write_archive(pages: DataFrame, folder: str, *, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One record for each row.  A null html is an empty payload, a null url an empty target; line ends in a
    url stand as %0D and %0A.  A payload of any length is stored as a whole.  Repeated rows are the same
    record, written as often.

    Of records with equal payloads of ``least_bytes`` or more, those with the smallest page_id are
    responses (repeated rows alike) and all others revisit it; a null page_id comes last.
    """
    spark = pages.sparkSession
    own = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    stored = own.groupBy("sha256").agg(F.first("payload").alias("payload"), F.min("page_id").alias("response_id"))
    length = F.octet_length("payload").cast("long")
    stored = stored.select("sha256", length.alias("length"), base32(F.sha1("payload")).alias("sha1"), "payload", "response_id")
    stored.write.parquet(f"{folder}/payloads")
    known = _payloads(spark, folder).select("sha256", "length", "sha1", "response_id")
    named = own.select("page_id", "url", "sha256").join(known, "sha256")
    revisit = (F.col("length") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    header = F.concat_ws(
        CRLF,
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("response_id")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.col("length").cast("string")),
    )
    named.select("page_id", "sha256", header.alias("header")).write.parquet(f"{folder}/headers")


def _payloads(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("sha256 binary, length long, sha1 string, payload binary, response_id long").parquet(f"{folder}/payloads")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Whole records (page_id, record): header, empty line, payload, two line ends.

    Revisits get the payload back too.  A payload whose bytes don't fit its digest is an error.
    """
    headers = spark.read.schema("page_id long, sha256 binary, header string").parquet(f"{folder}/headers")
    payloads = _payloads(spark, folder)
    sound = payloads.where(
        F.when(F.unhex(F.sha2("payload", 256)) == F.col("sha256"), True).otherwise(F.raise_error(F.lit("a payload doesn't fit its digest")).cast("boolean"))
    )
    joined = headers.join(sound.select("sha256", "payload"), "sha256")
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    return joined.select("page_id", F.concat(F.encode("header", "UTF-8"), end, F.col("payload"), end).alias("record"))


def _field(name: str) -> Column:
    return F.regexp_extract("header", rf"(?m)^{name}: ([^\r\n]*)", 1)


def parse_records(records: DataFrame) -> DataFrame:
    """(record) to page_id, url, record_type, refers_to, declared_digest and payload, from its bytes."""
    at = F.locate(CRLF * 2, F.decode("record", "ISO-8859-1"))  # one character a byte
    apart = records.withColumn("at", at).withColumn("header", F.decode(F.substring("record", 1, F.col("at") - 1), "UTF-8"))
    number = lambda x: F.regexp_extract(x, r"<urn:page:(-?\d+)>", 1)
    long = lambda x: F.when(x != "", x).cast("long")
    return apart.select(
        long(number(_field("WARC-Record-ID"))).alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"),
        long(number(_field("WARC-Refers-To"))).alias("refers_to"),
        _field("WARC-Payload-Digest").alias("declared_digest"),
        F.substring(F.col("record"), F.col("at") + 4, _field("Content-Length").cast("int")).alias("payload"),
    )


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as an archive, read it back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A payload whose digest isn't the one that its header declares is an error.  See ``write_archive`` for odd
    rows; an empty table gives an empty result, and other columns aren't read.
    """
    folder = folder or new_dir(pages.sparkSession, "warc")
    write_archive(pages, folder)
    parsed = parse_records(read_archive(pages.sparkSession, folder))
    parsed = parsed.withColumn("payload_digest", base32(F.sha1("payload")))
    unsound = F.raise_error(F.lit("a payload doesn't fit the digest in its header")).cast("string")
    digest = F.when(F.col("declared_digest") == F.concat(F.lit("sha1:"), F.col("payload_digest")), F.col("payload_digest")).otherwise(unsound)
    return parsed.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")

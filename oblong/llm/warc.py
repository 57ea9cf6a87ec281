"""Content-addressed web archive.

Payloads are stored once, under their SHA-256 digest, which is computed again when they are read; the records' exact headers
are kept in a table of their own. Joining both on the digest gives back every record as it was written.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oblong.llm.shared import discard, looked_up, shared_dir, stored

#: The public WARC 1.1 names.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"


@dataclass(frozen=True)
class Archive:
    """Where the two tables of an archive lie."""

    path: str

    @property
    def payloads(self) -> str:
        return f"{self.path}/payloads"

    @property
    def headers(self) -> str:
        return f"{self.path}/headers"


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n"))


def _header(date: str) -> Column:
    """The bytes of a record before its payload: WARC header, empty line, HTTP header, empty line."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _line("Content-Length", F.col("n").cast("string")), F.lit("\r\n"))
    revisit = F.col("record_type") == "revisit"
    held = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n"))
    named = lambda c: F.concat(F.lit(f"<{_ID}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", named(F.col("page_id"))),
        _line("WARC-Target-URI", F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]+", " ")),
        _line("WARC-Date", date),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(_line("WARC-Profile", REVISIT_PROFILE), _line("WARC-Refers-To", named(F.col("refers_to"))))).otherwise(F.lit("")),
        _line("Content-Type", "application/http;msgtype=response"),
        _line("Content-Length", held.cast("string")),
        F.lit("\r\n"),
        http,
    )


def write(pages: DataFrame, path: str | None = None, least_bytes: int = 100, date: str = "1970-01-01T00:00:00Z", broadcast_rows: int = 50_000) -> Archive:
    """Writes an archive of ``pages`` (page_id, url, html) into a new folder, by default in the shared one.

    Null html is an empty payload. Of records with equal payloads of at least ``least_bytes`` the one with the smallest page_id is a response and
    the others revisit it; smaller ones are all responses, though stored once too. Rows with null ids revisit a row that
    has one, if there is; rows repeated with the same id are all responses. Only digests that occur twice need to know of
    each other: they are found by a count before the shuffle, and joined to the pages by broadcast up to
    ``broadcast_rows`` of them; beyond that the most frequent ones are, and the others by a shuffled join. Either table
    keeps how many records have a digest, so that a reader can deal the many records of one payload out over several tasks.
    A payload of any length is a value of its own.
    """
    spark = pages.sparkSession
    archive = Archive(path or f"{shared_dir(spark)}/oblong-warc-{uuid.uuid4().hex}")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload").cast("long"))
    twice = rows.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n_")).where("n_ > 1")
    twice = stored(twice.withColumn("copies", F.col("n_")), "repeated")
    rows = looked_up(rows, twice, ["digest"], "n_", broadcast_rows)
    first = F.col("copies").isNull() | F.col("page_id").eqNullSafe(F.col("first_id"))
    payloads = rows.where(first).select("digest", "payload", F.coalesce("copies", F.lit(1)).alias("copies"))
    once = payloads.where("copies = 1")
    chosen = payloads.where("copies > 1").groupBy("digest").agg(F.first("payload").alias("payload"), F.first("copies").alias("copies"))
    once.unionByName(chosen).write.option("compression", "zstd").parquet(archive.payloads)
    revisit = ~first & (F.col("n") >= least_bytes)
    typed = rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first_id")))
    headers = typed.select("digest", F.coalesce("copies", F.lit(1)).alias("copies"), "record_type", _header(date).cast("binary").alias("header"))
    headers.write.option("compression", "zstd").parquet(archive.headers)
    discard(twice)
    return archive


#: Records of one payload that meet it in one task.
_EACH = 10_000


def _payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    """The stored payloads, and whether their bytes still have the digest they are stored under."""
    stored = spark.read.schema("digest string, payload binary, copies long").parquet(archive.payloads)
    return stored.withColumn("sound", F.sha2("payload", 256) == F.col("digest"))


def _with_payloads(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Every header with its payload's columns, null where there is none. The records of a payload with many are dealt out."""
    parts = F.ceil(F.col("copies") / _EACH).cast("int")
    dealt = headers.withColumn("part", F.pmod(F.xxhash64("header"), parts).cast("int")).drop("copies")
    copied = payloads.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("copies")
    return dealt.join(copied, ["digest", "part"], "left").drop("part")


def _headers(spark: SparkSession, archive: Archive, kind: str) -> DataFrame:
    return spark.read.schema("digest string, copies long, record_type string, header binary").parquet(archive.headers).where(F.col("record_type") == kind)


def _checked(rows: DataFrame, strict: bool) -> DataFrame:
    """Rows whose payload is lost or damaged raise an error, or stay with null payload columns."""
    if not strict:
        return rows
    bad = F.raise_error(F.concat(F.lit("payload is lost or damaged: "), F.col("digest"))).cast("boolean")
    return rows.where(F.when(F.coalesce("sound", F.lit(False)), True).otherwise(bad))


def records(spark: SparkSession, archive: Archive, strict: bool = True) -> DataFrame:
    """Every record as it was written: response headers joined with their payloads, and revisit headers alone.

    A response whose payload is lost or no longer has its digest is an error, or without ``strict`` a null record.
    """
    end = F.lit("\r\n\r\n").cast("binary")
    whole = _checked(_with_payloads(_headers(spark, archive, "response"), _payloads(spark, archive)), strict)
    responses = whole.select("digest", "header", F.when(F.col("sound"), F.concat("header", "payload", end)).alias("record"))
    return responses.unionByName(_headers(spark, archive, "revisit").select("digest", "header", F.concat("header", end).alias("record")))


def parsed(found: DataFrame, *more: str) -> DataFrame:
    """What the bytes of records say: type, ids, URL, digest, and the payload's bytes as their lengths place them; and the columns ``more``."""
    blank = F.lit("\r\n\r\n")
    # One character a byte, as position counts characters and substring of binary counts bytes.
    place = lambda name: F.position(blank, F.decode(F.col(name), "ISO-8859-1"))
    rows = found.withColumn("at", place("record")).withColumn("head", F.expr("decode(substring(record, 1, at - 1), 'UTF-8')"))
    rows = rows.withColumn("block", F.expr("substring(record, at + 4)"))  # HTTP header, payload, end of the record
    rows = rows.withColumn("http", place("block") + 3)
    rows = rows.withColumn("held", F.regexp_extract("head", r"(?m)^Content-Length: ([0-9]+)", 1).cast("int"))
    field = lambda name, value: F.regexp_extract("head", rf"(?m)^{name}: {value}", 1)
    page = lambda name: F.nullif(field(name, f"<{_ID}(-?[0-9]*)>"), F.lit("")).cast("long")
    return rows.select(
        page("WARC-Record-ID").alias("page_id"),
        field("WARC-Type", r"([^\r\n]*)").alias("record_type"),
        field("WARC-Target-URI", r"([^\r\n]*)").alias("url"),
        field("WARC-Payload-Digest", "sha256:([0-9a-f]*)").alias("header_digest"),
        page("WARC-Refers-To").alias("refers_to"),
        F.expr("substring(block, http + 1, held - http)").alias("payload"),
        *more,
    )


def read_back(spark: SparkSession, archive: Archive, strict: bool = True) -> DataFrame:
    """One row for each record: what its bytes say, with length and digest of its full payload computed from stored bytes.

    A revisit's payload is that of the record it refers to; it is found by the digest, as a length and a digest. A payload that is lost
    or no longer has its digest is an error; without ``strict`` its records are there with null length and digest.
    """
    found = records(spark, archive, strict)
    end = F.lit("\r\n\r\n").cast("binary")
    own = parsed(found.withColumn("record", F.coalesce("record", F.concat("header", end))))  # of a lost payload the header tells
    responses = own.where("record_type = 'response'")
    sound = F.sha2("payload", 256) == F.col("header_digest")
    responses = responses.select("page_id", F.when(sound, F.octet_length("payload").cast("long")).alias("payload_bytes"), F.when(sound, F.sha2("payload", 256)).alias("payload_digest"), "record_type", "refers_to")
    facts = _payloads(spark, archive).select("digest", "copies", "sound", F.when(F.col("sound"), F.octet_length("payload").cast("long")).alias("payload_bytes"), F.when(F.col("sound"), F.sha2("payload", 256)).alias("payload_digest"))
    revisits = _checked(_with_payloads(_headers(spark, archive, "revisit"), facts), strict)
    said = parsed(revisits.withColumn("record", F.concat("header", end)).select("record", "payload_bytes", "payload_digest"), "payload_bytes", "payload_digest")
    return responses.unionByName(said.select(responses.columns))

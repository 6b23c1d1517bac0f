"""WARC archives: writing pages as records, and reading them back by boundary-chain verification.

Writing: one record per page through Spark's text writer (a record's bytes plus
the closing CRLF CRLF as line separator), so files appear in any file system
Spark writes to, with its commit protocol.  Pages with equal payloads of at
least ``min_bytes`` bytes: the one with the smallest page_id is a ``response``, the
others are ``revisit`` records without a body that refer to it.

Reading: Spark's text reader cuts the files at the magic ``WARC/1.0`` CRLF, also
within large files.  Every piece is a candidate record; its header gives the
offset where the record must end.  Pointer jumping over (offset, successor)
pairs from the start of each file keeps the reachable records only: a magic
inside a payload, however well formed, lies off the chain and is rejected.

Defined results: null html is an empty payload; null page_id and url leave
their header out; repeated rows (same page_id, same payload) are all
responses; line breaks in a url are percent-encoded; an empty table writes no
record and reads back empty.  Other columns are not stored.

Scale: digests are joined by digest after a pre-aggregated minimum, thin rows
only, and a hot payload is one row on the right side, so AQE can split the
other.  Payloads never move in a shuffle: the length and digest of a record
that holds no other magic are computed where it is read.  Offsets come
from sums within a split and a prefix sum over the splits of a file.  Pointer
jumping takes log2(records of a file) rounds of thin joins, each stored in
the shared folder; ``records_per_file`` bounds a file.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silverline.session import materialize, shared_dir

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
RECORDS_PER_FILE = 20_000


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 (RFC 4648, 32 characters) of the SHA-1 of a binary column."""
    def spell(digest: Column) -> Column:  # 5 hex digits are 20 bits are 4 digits of base 32
        parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
        return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)

    return F.transform(F.array(F.sha1(data)), spell)[0]  # the digest is computed once


def capture_plan(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` as page_id, url, payload, payload_bytes, payload_digest, refers_to (null: a response)."""
    body = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    body = (body.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
            .withColumn("payload_digest", base32_sha1(F.col("payload").cast("binary"))))
    firsts = (body.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
              .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
              .select(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"), "first_id"))
    # only groups with several captures; written first, so that Catalyst sees how small it is
    firsts = materialize(firsts, "warc-firsts")
    out = body.join(firsts, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left")
    first = F.when(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return out.withColumn("refers_to", first).drop("d", "b", "first_id")


def _header(name: str, value: Column) -> Column:
    """A header line, left out when the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE) -> str:
    """Write one record per page under ``path``."""
    plan = capture_plan(pages, min_bytes)
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(HTTP), F.col("payload")))
    # control characters of a url would break its header line
    url = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    record = F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\n"),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        _header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        _header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit(f"WARC-Date: {DATE}\r\n"), _header("WARC-Target-URI", url),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.lit("")).otherwise(F.lit("Content-Type: application/http; msgtype=response\r\n")),
        _header("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)
    (plan.select(record.alias("value")).write.option("lineSep", END)
     .option("maxRecordsPerFile", records_per_file).text(path))
    return path


def _field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(F.length(found) > 0, found)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The files cut at each magic: file, block (split start), at (order within the split), piece."""
    return (spark.read.option("lineSep", MAGIC).text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece")))


def _payload(record: Column, head: Column, size: Column) -> Column:
    """Bytes of a record's payload: its block without the HTTP header."""
    def cut(block: Column) -> Column:
        return F.when(F.octet_length(block) > 0, F.substring(block, F.octet_length(F.substring_index(block.cast("string"), END, 1)) + 5,
                                                             F.octet_length(block))).otherwise(block)

    return F.transform(F.array(F.substring(record.cast("binary"), head + 1, size.cast("int"))), cut)[0]


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row per piece with its offset, successor offset (null: no valid header) and the fields of its header."""
    header = F.col("header")
    length = _field(header, "Content-Length")
    rows = (_pieces(spark, path).withColumn("header", F.substring_index("piece", END, 1))
            .withColumn("head", F.octet_length("header") + 4)
            .withColumn("size", F.when(length.rlike(r"^\d{1,18}$"), length.try_cast("long")))
            .withColumn("whole", F.octet_length("piece") == F.col("head") + F.col("size") + 4)
            # a piece that holds its whole record: the payload is measured here and does not move
            .withColumn("payload", F.when(F.col("whole"), _payload(F.col("piece"), F.col("head"), F.col("size")))))
    thin = rows.select(
        "file", "block", "at", F.octet_length("piece").alias("n"),
        F.when(F.octet_length("piece") >= F.col("head"), F.col("head") + F.col("size")).alias("span"), "whole",
        _field(header, "WARC-Type").alias("record_type"),
        F.regexp_extract(header, r"(?im)^WARC-Record-ID:[ \t]*<urn:page:(-?\d+)>", 1).try_cast("long").alias("page_id"),
        F.regexp_extract(header, r"(?im)^WARC-Refers-To:[ \t]*<urn:page:(-?\d+)>", 1).try_cast("long").alias("refers_to"),
        _field(header, "WARC-Target-URI").alias("url"), _field(header, "WARC-Payload-Digest").alias("stated_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    thin = materialize(thin, "warc-candidates")
    step = F.col("n") + len(MAGIC)
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    splits = (thin.groupBy("file", "block").agg(F.sum(step).alias("total"))
              .withColumn("base", F.coalesce(F.sum("total").over(
                  Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .select("file", "block", "base"))
    placed = (thin.withColumn("before", F.coalesce(F.sum(step).over(inside), F.lit(0))).join(splits, ["file", "block"])
              .withColumn("offset", F.col("base") + F.col("before") - len(MAGIC)))
    return placed.withColumn("next", F.col("offset") + len(MAGIC) + F.col("span") + 4).drop("before", "base")


def reachable(placed: DataFrame) -> DataFrame:
    """(file, offset) of the records on the chain from the start of each file, by pointer jumping."""
    pointer = materialize(placed.where("offset >= 0 and next > offset").select("file", "offset", "next"), "warc-pointers")
    reached = pointer.where("offset = 0").select("file", "offset")
    while True:
        hop = reached.join(pointer, ["file", "offset"]).select("file", F.col("next").alias("offset"))
        more = materialize(reached.unionByName(hop).distinct(), "warc-reached")
        far = pointer.alias("a").join(pointer.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.next") == F.col("b.offset"))) \
            .select("a.file", "a.offset", "b.next")
        reached, pointer = more, materialize(far, "warc-pointers")
        if pointer.isEmpty():  # no pointer reaches further: every chain was followed to its end
            return reached


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The verified records: file, offset, record_type, page_id, refers_to, url, digests, payload_bytes (and payload).

    A revisit record has the payload digest that it states; its own body is empty.
    """
    placed = materialize(candidates(spark, path), "warc-placed")
    chain = reachable(placed)
    starts = placed.join(chain, ["file", "offset"], "left_semi").where("next is not null")
    records = starts.select("file", "offset", "next", "whole", "record_type", "page_id", "refers_to", "url",
                            "stated_digest", "payload_bytes", "payload_digest", "block", "at")
    if not payloads and records.where("not whole").isEmpty():
        return records.drop("block", "at", "next", "whole")
    # records whose payload holds the magic: gather their pieces by record
    split = records.select("file", "offset", "next") if payloads else records.where("not whole").select("file", "offset", "next")
    owner = Window.partitionBy("file").orderBy("offset")
    marked = (placed.select("file", "block", "at", "offset").join(
        split.select("file", "offset", F.col("offset").alias("start"), F.col("next").alias("stop")), ["file", "offset"], "left")
        .withColumn("start", F.last("start", ignorenulls=True).over(owner))
        .withColumn("stop", F.last("stop", ignorenulls=True).over(owner))
        .where("offset >= start and offset < stop").select("file", "block", "at", "offset", "start"))
    pieces = _pieces(spark, path).join(marked, ["file", "block", "at"])
    full = (pieces.groupBy("file", "start").agg(F.sort_array(F.collect_list(F.struct("offset", "piece"))).alias("p"))
            .select("file", F.col("start").alias("offset"),
                    F.array_join(F.transform("p", lambda x: x["piece"]), MAGIC).alias("text")))
    full = full.withColumn("header", F.substring_index("text", END, 1))
    payload = _payload(F.col("text"), F.octet_length("header") + 4, _field(F.col("header"), "Content-Length").try_cast("long"))
    full = full.select("file", "offset", payload.alias("payload"))
    out = records.drop("block", "at", "next").join(full, ["file", "offset"], "left")
    out = (out.withColumn("payload_bytes", F.coalesce("payload_bytes", F.octet_length("payload").cast("long")))
           .withColumn("payload_digest", F.coalesce("payload_digest", base32_sha1(F.col("payload")))).drop("whole"))
    return out if payloads else out.drop("payload")


def pages_through_warc(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the archives, read them back, and resolve revisits: one row per page."""
    spark = pages.sparkSession
    path = shared_dir(spark, f"warc/{uuid.uuid4().hex}")
    write_warc(pages, path, min_bytes)
    records = materialize(read_warc(spark, path, payloads=False), "warc-records")
    # a revisit takes the size of the record that it refers to; one row per referred page
    target = (records.where("record_type = 'response' and page_id is not null")
              .join(records.where("refers_to is not null").select(F.col("refers_to").alias("page_id")).distinct(), "page_id", "left_semi")
              .groupBy(F.col("page_id").alias("t"), F.concat(F.lit("sha1:"), F.col("payload_digest")).alias("t_digest"))
              .agg(F.max("payload_bytes").alias("t_bytes")))
    target = materialize(target, "warc-targets")
    out = records.join(target, (F.col("refers_to") == F.col("t")) & (F.col("stated_digest") == F.col("t_digest")), "left")
    revisit = F.col("record_type") == "revisit"
    return out.select(
        "page_id", F.when(revisit, F.col("t_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.substring("stated_digest", 6, 32)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", "refers_to")

"""Streaming queries: the stream's final result equals the batch answer on the same rows.

The input "arrives" as Parquet chunks written by Spark, which together hold every row;
``maxFilesPerTrigger`` bounds the micro-batches.  Only the rate windows, which have a watermark,
need their chunks in time order, two files and one micro-batch each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from silverline.functions import patterns as P
from silverline.plans import duck as D
from silverline.plans.fixtures import derived, duck_with, read_table
from silverline.plans.queries_docs import _duck_mojibake
from silverline.plans.registry import register
from silverline.session import shared_dir
from silverline.streaming import jobs as J

CHUNKS = 3
FILES_PER_CHUNK = 2


def _dirs(spark, name):
    base = shared_dir(spark, f"stream/{name}-{uuid.uuid4().hex[:12]}")
    return f"{base}/in", f"{base}/out", f"{base}/ckpt"


def _write_chunks(df, path, chunks=CHUNKS):
    """Deal all rows into chunks by a hash (nulls have one too), each its own job with the partitions Spark reads.

    Gives the files of a micro-batch: a chunk's share, but no more than keep all cores busy twice.
    """
    spark = df.sparkSession
    chunk = F.pmod(F.xxhash64(*df.columns), F.lit(chunks))
    for i in range(chunks):
        df.where(chunk == i).write.mode("append").parquet(path)
    files = len(spark.read.parquet(path).inputFiles())
    return max(1, min(-(-files // chunks), 2 * spark.sparkContext.defaultParallelism))


_DAYS = ["2024-01-11", "2024-01-21"]


def _write_day_chunks(logs, path):
    """Write all rows in time order, each chunk as its own job of FILES_PER_CHUNK files: a chunk has to be one micro-batch,
    or the watermark drops what is left of it.  Rows without a time are in the first chunk."""
    at, days = F.col("created_at"), [F.lit(d).cast("timestamp_ntz") for d in _DAYS]
    for part in (at.isNull() | (at < days[0]), (at >= days[0]) & (at < days[1]), at >= days[1]):
        logs.where(part).repartition(FILES_PER_CHUNK).write.mode("append").parquet(path)


@register("stream_ingest_documents", ["STM1", "TXT1", "TXT2"], f"""
select source, doc_id, md5({D.collapse(_duck_mojibake('text'))}) as text_md5, lang from documents""")
def q_stream_ingest(spark, sf_dir):
    src, out, ckpt = _dirs(spark, "ingest")
    docs = read_table(spark, sf_dir, "documents").select("source", "doc_id", "text", "lang")
    files = _write_chunks(docs, src)
    J.incremental_ingest(spark, src, docs.schema, out, ckpt, "source", "doc_id", ["text"], max_files_per_trigger=files)
    got = J.read_ingested(spark, out)
    return got.select("source", "doc_id", F.md5("text").alias("text_md5"), "lang")


def _ordered_chunks(df, path, key, chunks=CHUNKS, second=None):
    """Write all rows by ranges of ``key``, each chunk its own job of as many files; one file of the second chunk is left to ``second``."""
    spark = df.sparkSession
    files = max(2, spark.sparkContext.defaultParallelism)
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    step = -(-(hi + 1 - lo) // chunks)
    for i in range(chunks):
        part = df.where((F.col(key) >= lo + i * step) & (F.col(key) < lo + (i + 1) * step) | (F.col(key).isNull() if i == 0 else F.lit(False)))
        other = second if i == 1 else None
        part.repartition(files - (1 if other else 0)).write.mode("append").parquet(path)
        if other:
            other()
    return files


@register("stream_ingest_quarantine", ["STM1", "CAT8", "PRJ5", "CAT6"], """
select 'rows' as what, source as name, count(*) as rows, 0::bigint as only_stream, 0::bigint as only_batch from documents group by source
union all select 'error', 'broken.parquet', 1, 0, 0
union all select 'success', 'files read', (select count(*) from documents), 0, 0""")
def q_stream_quarantine(spark, sf_dir):
    """One broken file among three chunks: its error row, and the rows of the stream against one batch, on every column."""
    from silverline.operators.exchange import redistribute
    from silverline.operators.provenance import add_provenance
    from silverline.plans.clean import clean_rows

    src, out, ckpt = _dirs(spark, "quarantine")
    docs = read_table(spark, sf_dir, "documents")

    def broken():
        """A file that is no Parquet, though its name says so."""
        where = spark._jvm.org.apache.hadoop.fs.Path
        fs = where(src).getFileSystem(spark._jsc.hadoopConfiguration())
        docs.select("text").where("text is not null").limit(1).coalesce(1).write.mode("append").text(f"{src}-text")
        names, files = [], fs.listStatus(where(f"{src}-text"))
        for f in files:
            if f.getPath().getName().endswith(".txt"):
                names.append(f.getPath())
        fs.rename(names[0], where(f"{src}/broken.parquet"))

    files = _ordered_chunks(docs, src, "doc_id", second=broken)
    job = J.FileIngest(spark, out, docs.schema, F.col("source"), ["doc_id"], J.provenance_transform("parquet", "2024-01-01", "text"))
    J.ingest_stream(job, src, ckpt, files, glob="*.parquet")
    columns = ["doc_id", "text", "lang", "source", "n_chars", "_dataset_id", "_row_number", "_source_type", "_ingested_at", "_content_hash"]
    rows = J.read_ingested(spark, out)
    batch = add_provenance(clean_rows(redistribute(docs, "doc_id")), F.col("source"), "", "parquet", ["doc_id"], "2024-01-01", "text")
    both = [df.select(F.lit(side).alias("side"), F.col("_dataset_id").alias("name"), F.xxhash64(*columns).alias("row")) for side, df in (("s", rows), ("b", batch))]
    # equal rows cancel out: signed counts per row, kept whole
    signs = both[0].unionByName(both[1]).groupBy("name", "row").agg(F.sum(F.when(F.col("side") == "s", 1).otherwise(-1)).alias("n"), F.count_if(F.col("side") == "s").alias("s"))
    compared = signs.groupBy("name").agg(F.sum("s").alias("rows"), F.sum(F.greatest("n", F.lit(0))).cast("bigint").alias("only_stream"),
                                         F.sum(F.greatest(-F.col("n"), F.lit(0))).cast("bigint").alias("only_batch"))
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("only_stream", "only_batch")]
    status = J.file_status(spark, out)
    errors = status.where("status = 'error'").select(F.lit("error").alias("what"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.lit(1).cast("bigint").alias("rows"), *zero)
    good = status.where("status = 'success'").withColumnRenamed("path", "_source_file")
    read = rows.join(good, rows["_source_file"] == good["_source_file"], "left_semi").agg(F.count("*").alias("rows")).select(
        F.lit("success").alias("what"), F.lit("files read").alias("name"), "rows", *zero)
    return compared.select(F.lit("rows").alias("what"), "name", "rows", "only_stream", "only_batch").unionByName(errors).unionByName(read)


_DUCK_LIMITS = f"""
(select k.id as api_key_id, coalesce(p.rate, {dict((x[0], x[3]) for x in P.PLAN_LIMITS)[P.DEFAULT_PLAN]}) as lim
 from api_keys k left join users u on u.id = k.user_id
 left join (values {', '.join(f"('{x[0]}', {x[3]})" for x in P.PLAN_LIMITS)}) as p(plan, rate) on p.plan = u.plan)"""


@register("stream_rate_windows", ["STM2", "JOIN4"], duck_with("usage_logs", "api_keys", "users") + f"""
select w.api_key_id, w.window_start, w.requests, coalesce(l.lim, 10) as "limit",
  w.requests > coalesce(l.lim, 10) as over_limit
from (select api_key_id, time_bucket(interval 1 minute, created_at) as window_start, count(*) as requests
      from usage_logs group by 1, 2) w left join {_DUCK_LIMITS} l on l.api_key_id = w.api_key_id""")
def q_stream_rate(spark, sf_dir):
    src, out, ckpt = _dirs(spark, "rate")
    logs = derived(spark, sf_dir, "usage_logs")
    _write_day_chunks(logs, src)
    J.rate_windows(spark, src, logs.schema, derived(spark, sf_dir, "api_keys"), derived(spark, sf_dir, "users"), out, ckpt,
                   max_files_per_trigger=FILES_PER_CHUNK)
    final = J.latest_per_key(spark.read.parquet(out), ["api_key_id", "window_start"])
    return final.select("api_key_id", "window_start", "requests", "limit", "over_limit")


@register("stream_daily_counters", ["STM3", "AGG14"], duck_with("usage_logs") + """
select api_key_id, cast(created_at as date) as date, count(*) as requests, cast(sum(bytes_transferred) as bigint) as bytes
from usage_logs group by 1, 2""")
def q_stream_daily(spark, sf_dir):
    src, out, ckpt = _dirs(spark, "daily")
    logs = derived(spark, sf_dir, "usage_logs")
    # the log arrives in the order of its days, a chunk a micro-batch
    files = _ordered_chunks(logs.withColumn("day_no", F.unix_date(F.to_date("created_at"))), src, "day_no", 4)
    J.daily_counters(spark, src, logs.schema, out, ckpt, max_files_per_trigger=files)
    return J.daily_totals(spark, out).select("api_key_id", "date", "requests", "bytes")


@register("stream_ingest_status", ["CAT8", "STM1"], """
select source as dataset_id, 'success' as status from documents group by source""")
def q_stream_status(spark, sf_dir):
    src, out, ckpt = _dirs(spark, "status")
    docs = read_table(spark, sf_dir, "documents").select("source", "doc_id", "text", "lang")
    files = _write_chunks(docs, src, 2)
    J.incremental_ingest(spark, src, docs.schema, out, ckpt, "source", "doc_id", ["text"], max_files_per_trigger=files)
    return J.dataset_status(spark, out).select("dataset_id", "status")

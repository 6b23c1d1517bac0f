"""Structured Streaming jobs (STM1-STM3).

Every job reads a directory stream with an explicit schema, keeps its offsets
and state under the shared ``spark.checkpoint.dir`` (so a lost executor or a
restarted driver resumes where it stopped), and writes each micro-batch with
``foreachBatch`` into its own ``_batch=<epoch>`` folder in overwrite mode: a
re-executed batch replaces its own output instead of appending twice.
Readers of the sink keep the latest row per key (``latest_per_key``), so
update-mode aggregates collapse to their final values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from silverline.functions import text as X
from silverline.functions.patterns import DEFAULT_PLAN, PLAN_LIMITS
from silverline.operators.provenance import number_rows
from silverline.operators.usage import with_plan_limits
from silverline.operators.joins import attach_per_key
from silverline.plans.clean import clean_rows
from silverline.sources.readers import literal_paths


DEFAULT_RATE = dict((p[0], p[3]) for p in PLAN_LIMITS)[DEFAULT_PLAN]


def _run(writer, checkpoint: str, available_now: bool = True, timeout_s: int | None = None):
    w = writer.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    q = w.start()
    if available_now:
        q.awaitTermination(timeout_s)
    return q


def _batch_path(sink: str, epoch_id: int) -> str:
    return f"{sink.rstrip('/')}/_batch={epoch_id}"


# ---------------------------------------------------------------------------
# STM1 incremental ingest, CAT8 status
# ---------------------------------------------------------------------------

CORRUPT = "_corrupt_record"


class FileIngest:
    """Micro-batches of files -> rows, errors and status, one folder of each per epoch.

    The stream carries the paths of new files (their content is pruned); a batch reads its files
    itself, so a file that cannot be read is set aside and the stream goes on.  A batch is tried as a whole; only
    where that fails are its files searched, by halves, for those that cannot be read.

    * ``sink``: the rows of all readable files after ``transform``, numbered per dataset (WIN1); numbers go on where the
      last batch ended (running totals, one row per dataset and epoch, under ``<sink>_totals``);
    * ``<sink>_errors``: path, record, reason - one row per unreadable file and per record that does not parse;
    * ``<sink>_files``: path, status (``processing`` until the batch is written, then ``success`` or ``error``), message;
    * ``<sink>_status``: dataset_id, status, message - the datasets of the batch.

    Every folder is overwritten by its epoch: a batch that runs again replaces what it wrote, and totals of earlier
    epochs only are read, so it changes nothing.  Columns starting with ``_`` are left to the job.
    """

    def __init__(self, spark: SparkSession, sink: str, schema: T.StructType | str, dataset: Column, order_by: list[str], transform: Callable | None = None,
                 fmt: str = "parquet", options: dict | None = None):
        self.spark, self.sink, self.fmt, self.options = spark, sink.rstrip("/"), fmt, options or {}
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        self.dataset, self.order_by, self.transform = dataset, order_by, transform

    def read(self, paths: list[str]) -> DataFrame:
        """Rows of ``paths`` with ``_source_file``, and ``_corrupt_record`` where a record does not parse."""
        reader, schema = self.spark.read.options(recursiveFileLookup="true", **self.options), self.schema
        if self.fmt in ("csv", "json"):
            schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
            reader = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
            reader = reader.option("columnPruning", "false") if self.fmt == "csv" else reader
        rows = reader.schema(schema).format(self.fmt).load(literal_paths(paths)).withColumn("_source_file", F.col("_metadata.file_path"))
        return rows if CORRUPT in rows.columns else rows.withColumn(CORRUPT, F.lit(None).cast("string"))

    def unreadable(self, paths: list[str]) -> dict[str, str]:
        """Files that fail when they are read to the end, with the message."""
        try:
            self.read(paths).write.format("noop").mode("overwrite").save()
            return {}
        except Exception as e:  # noqa: BLE001 - whatever a reader says about a file
            if len(paths) == 1:
                return {paths[0]: str(e).strip().splitlines()[0][:500]}
        half = len(paths) // 2
        return self.unreadable(paths[:half]) | self.unreadable(paths[half:])

    def __call__(self, batch: DataFrame, epoch_id: int) -> None:
        paths = sorted(r["path"] for r in batch.select("path").distinct().collect())  # maxFilesPerTrigger at most
        bad: dict[str, str] = {}
        self._files(paths, epoch_id, "processing", bad)
        if paths:
            try:
                self._write(paths, epoch_id)
            except Exception:
                bad = self.unreadable(paths)
                if not bad:  # not the files' fault
                    raise
                self._write([p for p in paths if p not in bad], epoch_id)
        self._errors([p for p in paths if p not in bad], epoch_id, bad)
        self._files(paths, epoch_id, "success", bad)

    def _write(self, paths: list[str], epoch_id: int) -> None:
        if not paths:
            return
        rows = self.read(paths).withColumn("_dataset_id", self.dataset).where(F.col(CORRUPT).isNull()).drop(CORRUPT)
        rows = self.transform(rows) if self.transform else rows
        numbered = number_rows(rows, ["_dataset_id"], self.order_by, out="__local")
        before = self._totals(epoch_id).withColumnRenamed("rows", "__offset")
        out = attach_per_key(numbered, before, ["_dataset_id"], how="left").withColumn(
            "_row_number", F.col("__local") + F.coalesce("__offset", F.lit(0))).drop("__local", "__offset")
        out = out.withColumn("_batch_id", F.lit(epoch_id).cast("bigint"))
        out.write.mode("overwrite").parquet(_batch_path(self.sink, epoch_id))
        written = self.spark.read.parquet(_batch_path(self.sink, epoch_id))
        mine = written.groupBy("_dataset_id").agg(F.max("_row_number").alias("rows"))
        mine.write.mode("overwrite").parquet(_batch_path(self.sink + "_totals", epoch_id))
        mine.select(F.col("_dataset_id").alias("dataset_id"), F.lit(epoch_id).cast("bigint").alias("batch_id"), F.lit("success").alias("status"),
                    F.lit(None).cast("string").alias("error_message")).write.mode("overwrite").parquet(_batch_path(self.sink + "_status", epoch_id))

    def _totals(self, epoch_id: int) -> DataFrame:
        """Rows per dataset after the EARLIER epochs: a re-run of this one does not see its own."""
        try:
            earlier = self.spark.read.parquet(self.sink + "_totals").where(F.col("_batch") < epoch_id)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            kind = self.spark.createDataFrame([], self.schema).withColumn("_source_file", F.lit("")).select(self.dataset.alias("_dataset_id")).schema
            return self.spark.createDataFrame([], kind).withColumn("rows", F.lit(0).cast("bigint"))
        return earlier.groupBy("_dataset_id").agg(F.max("rows").alias("rows"))

    def _errors(self, good: list[str], epoch_id: int, bad: dict[str, str]) -> None:
        errors = self.spark.createDataFrame([(p, None, m) for p, m in bad.items()], "path string, record string, reason string")
        if good and self.fmt in ("csv", "json"):
            rows = self.read(good)
            values = F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in self.schema.fields]))
            # Spark's readers want another column read beside the broken record
            records = rows.where(F.col(CORRUPT).isNotNull() & (F.coalesce(F.length(values), F.lit(0)) >= 0))
            errors = errors.unionByName(records.select(F.col("_source_file").alias("path"), F.col(CORRUPT).alias("record"), F.lit("malformed record").alias("reason")))
        errors.write.mode("overwrite").parquet(_batch_path(self.sink + "_errors", epoch_id))

    def _files(self, paths: list[str], epoch_id: int, status: str, bad: dict[str, str]) -> None:
        rows = [(p, epoch_id, "error" if p in bad else status, bad.get(p)) for p in paths]
        self.spark.createDataFrame(rows, "path string, batch_id bigint, status string, error_message string") \
            .write.mode("overwrite").parquet(_batch_path(self.sink + "_files", epoch_id))


def ingest_stream(job: FileIngest, source_dir: str, checkpoint: str, max_files_per_trigger: int = 1000, available_now: bool = True, glob: str | None = None):
    """STM1: run ``job`` on the files that arrive under ``source_dir``."""
    reader = job.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary") \
        .options(maxFilesPerTrigger=max_files_per_trigger, recursiveFileLookup="true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    paths = reader.load(source_dir).select("path")
    return _run(paths.writeStream.foreachBatch(job), checkpoint, available_now)


def provenance_transform(source_type: str, ingested_at: str | None = None, content_col: str | None = None, plan: list[dict] | None = None) -> Callable:
    """The whole row-wise ``clean`` and the provenance columns of PRJ5 (the row number is the job's)."""
    def transform(rows: DataFrame) -> DataFrame:
        out = clean_rows(rows, plan).withColumn("_source_type", F.lit(source_type))
        if ingested_at is not None:
            out = out.withColumn("_ingested_at", F.lit(ingested_at))
        return out.withColumn("_content_hash", X.content_hash(content_col)) if content_col else out

    return transform


def incremental_ingest(spark: SparkSession, source_dir: str, schema: T.StructType | str, sink: str, checkpoint: str,
                       dataset_col: str, order_col: str, text_cols: list[str], max_files_per_trigger: int | None = None,
                       available_now: bool = True):
    """STM1 on Parquet files with a dataset column: mojibake and white space of ``text_cols`` repaired, rows numbered per dataset.

    The job's own columns but ``_row_number`` and ``_batch_id`` are dropped.  See ``FileIngest`` for what it keeps of files that fail.
    """
    def transform(rows: DataFrame) -> DataFrame:
        return rows.withColumns({c: X.collapse_ws(X.fix_mojibake(c)) for c in text_cols}).drop("_source_file")

    job = FileIngest(spark, sink, schema, F.col(dataset_col), [order_col], transform)
    return ingest_stream(job, source_dir, checkpoint, max_files_per_trigger or 1000, available_now, glob="*.parquet")


def read_ingested(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(sink).drop("_batch")


def file_status(spark: SparkSession, sink: str) -> DataFrame:
    """CAT8 per file: path, batch_id, status, error_message."""
    return spark.read.parquet(sink.rstrip("/") + "_files").drop("_batch")


def dataset_status(spark: SparkSession, sink: str) -> DataFrame:
    """CAT8: latest status per dataset over all ingest batches (error message kept)."""
    st = spark.read.parquet(sink.rstrip("/") + "_status").drop("_batch")
    w = Window.partitionBy("dataset_id").orderBy(F.col("batch_id").desc())
    return st.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


# ---------------------------------------------------------------------------
# STM2 per-minute request windows vs plan limits, STM3 live daily counters
# ---------------------------------------------------------------------------


def _updates_to_sink(agg: DataFrame, sink: str, checkpoint: str, enrich=None, available_now: bool = True):
    def handle(batch: DataFrame, epoch_id: int):
        out = enrich(batch) if enrich else batch
        out.withColumn("_epoch", F.lit(epoch_id).cast("bigint")).write.mode("overwrite").parquet(
            _batch_path(sink, epoch_id))

    return _run(agg.writeStream.outputMode("update").foreachBatch(handle), checkpoint, available_now)


def rate_windows(spark: SparkSession, source_dir: str, schema, keys: DataFrame, users: DataFrame, sink: str,
                 checkpoint: str, window: str = "1 minute", watermark: str = "10 minutes",
                 max_files_per_trigger: int | None = None, available_now: bool = True):
    """STM2: requests per API key per tumbling window; rows later than the watermark are dropped.

    As in Spark 3.4+, an input row is late when it is older than the watermark of the
    previous micro-batch (the current batch's watermark only evicts state).

    Each update is enriched with the key's plan rate limit (keys -> users -> plans, all small
    and broadcast after a size check) and an ``over_limit`` flag.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    s = reader.parquet(source_dir).withColumn("__ts", F.col("created_at").cast("timestamp"))
    agg = s.withWatermark("__ts", watermark).groupBy(F.window("__ts", window), "api_key_id").agg(
        F.count(F.lit(1)).alias("requests"))
    plan_of_key = keys.select(F.col("id").alias("api_key_id"), "user_id").join(
        users.select(F.col("id").alias("user_id"), "plan"), "user_id", "left")
    limits = with_plan_limits(plan_of_key).select("api_key_id", F.col("plan_rate_limit_per_minute").alias("limit"))

    def enrich(batch: DataFrame) -> DataFrame:
        b = batch.select("api_key_id", F.col("window.start").cast("timestamp_ntz").alias("window_start"), "requests")
        # keys without a known user fall back to the default plan's limit
        out = attach_per_key(b, limits, ["api_key_id"], how="left").withColumn(
            "limit", F.coalesce("limit", F.lit(DEFAULT_RATE)))
        return out.withColumn("over_limit", F.col("requests") > F.col("limit"))

    return _updates_to_sink(agg, sink, checkpoint, enrich, available_now)


DAYS_ON = 1_000_000


def daily_counters(spark: SparkSession, source_dir: str, schema, sink: str, checkpoint: str,
                   max_files_per_trigger: int | None = None, available_now: bool = True, lateness_days: int = 1):
    """STM3: requests and bytes per API key and day, updated as the log grows; read them with ``daily_totals``.

    A day is finished once a row has been seen of the day ``lateness_days`` after the next; later rows of it
    are dropped, and its state goes.  Rows without a time are a group of their own, which never ends (a row per key).
    Each epoch merges its updates into the open days of the epoch before and writes them once, finished days
    apart: a day is written as finished by one epoch only, and the open days do not grow with the log.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    wait = 1 + lateness_days
    # a watermark begins at 1970: days are moved on so that none lies before it
    s = reader.parquet(source_dir).withColumn("__day", F.date_add(F.to_date("created_at"), DAYS_ON).cast("timestamp"))
    agg = s.withWatermark("__day", f"{wait} days").groupBy("api_key_id", "__day").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("bytes_transferred").cast("bigint").alias("bytes"))

    def handle(batch: DataFrame, epoch_id: int):
        merged = batch.select("api_key_id", F.date_sub(F.to_date("__day"), DAYS_ON).alias("date"), "requests", "bytes")
        finished = F.lit(False)
        before = _open_days(spark, sink, epoch_id)
        if before is not None:
            # as Spark does with its state: the last day of the EARLIER batches closes days
            seen = before.agg(F.max("date")).first()[0]
            both = merged.withColumn("__v", F.lit(1)).unionByName(before.select(*merged.columns).withColumn("__v", F.lit(0)))
            newest = F.max_by(F.struct("requests", "bytes"), "__v")
            merged = both.groupBy("api_key_id", "date").agg(newest.alias("n")).select("api_key_id", "date", "n.requests", "n.bytes")
            finished = F.coalesce(F.col("date") <= F.date_sub(F.lit(seen), wait), finished)
        merged.withColumn("_finished", finished.cast("int")).write.mode("overwrite").partitionBy("_finished").parquet(_batch_path(sink, epoch_id))

    return _run(agg.writeStream.outputMode("update").foreachBatch(handle), checkpoint, available_now)


def _epochs(spark: SparkSession, sink: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", sink).parquet(sink)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _open_days(spark: SparkSession, sink: str, before_epoch: int) -> DataFrame | None:
    """Days that the last epoch before ``before_epoch`` left open."""
    rows = _epochs(spark, sink)
    last = None if rows is None else rows.where(F.col("_batch") < before_epoch).agg(F.max("_batch")).first()[0]
    return None if last is None else rows.where((F.col("_batch") == last) & (F.col("_finished") == 0))


def daily_totals(spark: SparkSession, sink: str) -> DataFrame:
    """Rows (api_key_id, date, requests, bytes) of ``daily_counters``: every finished day, and the open ones of the last epoch."""
    rows = spark.read.option("basePath", sink).parquet(sink)
    last = rows.agg(F.max("_batch")).first()[0]
    return rows.where((F.col("_finished") == 1) | (F.col("_batch") == last)).drop("_batch", "_finished")


def latest_per_key(sink_df: DataFrame, keys: list[str], version_col: str = "_epoch") -> DataFrame:
    """Final value per key from update-mode output: the row of the latest epoch."""
    w = Window.partitionBy(*keys).orderBy(F.col(version_col).desc())
    return sink_df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", version_col, "_batch")

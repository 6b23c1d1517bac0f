"""Gold promotion with a ledger (CAT3, CAT4, CAT5, SNK2, AGG8): only datasets that changed are promoted again.

Under ``root``: ``tables`` (rows), ``meta/gold_tables``, ``meta/gold_columns`` - a folder per dataset, replaced when the
dataset is promoted - and ``meta/ledger``, one folder per run with the fingerprint of every dataset it
promoted.  The ledger is written last: a run that dies before has promoted nothing by the ledger, and the next
run does its datasets again.  All datasets of a run are profiled and written together.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silverline.operators.catalog import promote_all
from silverline.session import materialize
from silverline.sources.sinks import write_dataset


def _key(dataset: Column) -> Column:
    """Folder name of a dataset: safe for any id, null and '' apart."""
    return F.md5(F.coalesce(F.concat(F.lit("="), dataset.cast("string")), F.lit("")))


def dataset_fingerprints(df: DataFrame, dataset_col: str) -> DataFrame:
    """AGG8 per dataset: (dataset_id, rows, fingerprint), in any row order; columns starting with ``_`` do not count.

    The sum of all rows' hashes is partially aggregated, so a hot dataset is a row per task in the shuffle.
    """
    user = [f for f in df.schema.fields if not f.name.startswith("_") and f.name != dataset_col]
    kinds = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in user)
    row = F.xxhash64(*[F.col(f"`{f.name}`") for f in user]).cast("decimal(38,0)")
    return df.groupBy(F.col(dataset_col).alias("dataset_id")).agg(F.count(F.lit(1)).alias("rows"), F.sum(row).alias("digest")).select(
        "dataset_id", "rows", F.concat_ws(":", F.col("rows").cast("string"), F.col("digest").cast("string"), F.md5(F.lit(kinds))).alias("fingerprint"))


def read_ledger(spark: SparkSession, root: str) -> DataFrame | None:
    """Rows (dataset_id, dataset_key, rows, fingerprint, run) of all runs, or None before the first one."""
    try:
        return spark.read.parquet(f"{root.rstrip('/')}/meta/ledger").withColumnRenamed("_run", "run")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def promote_changed(df: DataFrame, dataset_col: str, root: str, force: bool = False, info: DataFrame | None = None) -> DataFrame:
    """CAT5 with skip and force: (dataset_id, action, rows), ``promoted`` or ``skipped``.

    A dataset is promoted if it is new, if its fingerprint differs from that of its last promotion, or
    with ``force``.  ``info`` (dataset_id, space_id, source_file, source_type) goes into its metadata.
    A run without changes writes nothing.
    """
    spark, root = df.sparkSession, root.rstrip("/")
    now = materialize(dataset_fingerprints(df, dataset_col).withColumn("dataset_key", _key(F.col("dataset_id"))), "fingerprints")
    ledger = read_ledger(spark, root)
    run = 0
    if ledger is None:
        state = now.withColumn("changed", F.lit(True))
    else:
        run = ledger.agg(F.max("run")).first()[0] + 1
        last = ledger.groupBy("dataset_key").agg(F.max_by("fingerprint", "run").alias("last"))
        state = materialize(now.join(last, "dataset_key", "left").withColumn("changed", F.lit(force) | ~F.col("last").eqNullSafe(F.col("fingerprint"))), "promotion")
    changed = state.where("changed")
    if not changed.isEmpty():
        _promote(df, changed, dataset_col, root, run, info)
    return state.select("dataset_id", F.when(F.col("changed"), "promoted").otherwise("skipped").alias("action"), "rows")


def _promote(df: DataFrame, changed: DataFrame, dataset_col: str, root: str, run: int, info: DataFrame | None) -> None:
    keyed = df.withColumn("dataset_key", _key(F.col(dataset_col)))
    todo = keyed.join(changed.select("dataset_key"), "dataset_key", "left_semi")
    tables, columns = promote_all(todo.drop("dataset_key"), dataset_col)
    columns = materialize(columns, "gold-columns")
    table_id = F.md5(F.concat_ws(":", "dataset_key", "fingerprint"))
    facts = changed.select(F.col("dataset_id").alias("__id"), "dataset_key", table_id.alias("id"))
    described = columns.groupBy("dataset_id").agg(F.sort_array(F.collect_list(F.struct(
        "ordinal", F.col("column_name").alias("name"), F.col("column_type").alias("type"), "sql_type", F.col("is_nullable").alias("nullable"),
        F.round("valid_percentage", 4).alias("valid_percentage")))).alias("c"))
    schema = F.to_json(F.struct(F.transform("c", lambda x: x.dropFields("ordinal")).alias("columns")))

    def same(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
        return a.join(b, F.col("dataset_id").eqNullSafe(F.col(key)), "left").drop(key)

    out = same(tables, described.select(F.col("dataset_id").alias("__c"), schema.alias("schema_json")), "__c")
    out = same(out, facts, "__id")
    if info is not None:
        out = same(out, info.select(F.col("dataset_id").alias("__i"), "space_id", "source_file", "source_type"), "__i")
    out = out.withColumn("parquet_path", F.concat(F.lit(f"{root}/tables/dataset_key="), "dataset_key")).withColumn("is_queryable", F.lit(True))
    columns = same(columns, facts.withColumnRenamed("id", "gold_table_id"), "__id").withColumn("id", F.md5(F.concat_ws(":", "gold_table_id", "ordinal")))
    write_dataset(todo, f"{root}/tables", "dataset_key")
    for name, frame in (("gold_tables", out), ("gold_columns", columns)):
        frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_key").parquet(f"{root}/meta/{name}")
    changed.select("dataset_id", "dataset_key", "rows", "fingerprint").write.mode("overwrite").parquet(f"{root}/meta/ledger/_run={run}")

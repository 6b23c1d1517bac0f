"""Provenance columns, per-dataset row numbers, duplicate content (PRJ4, PRJ5, WIN1, AGG17).

Row numbers per dataset must not put a whole dataset into one task (one
dataset may hold a third of all rows).  ``number_rows`` therefore works like
``zipWithIndex`` per key:

1. the rows are written once (Parquet in the shared checkpoint folder) with an id, so that whatever made them,
   regexes over long texts too, runs once: a range exchange computes its input twice, for its bounds and for its rows;
2. the ids with their (dataset, order key) are range-partitioned - a hot dataset spans many partitions;
3. sort within partitions; ``monotonically_increasing_id`` is then the local
   position (partition id in the high bits);
4. a small table of (partition, dataset) -> first id, row count - at most
   partitions + datasets rows - gives each slice its offset through a running
   sum per dataset;
5. that small table is joined to the ids, and the ids to the rows.

The partition id and position of every id are persisted too before the slice table is derived: two separate
range exchanges would each sample their own bounds, and at scale those bounds
(hence partition ids) could differ between the two uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from silverline.functions.text import content_hash
from silverline.session import materialize

INTERNAL_PREFIX = "_"


def split_internal(df: DataFrame) -> tuple[list[str], list[str]]:
    """PRJ4: (user columns, internal ``_`` columns)."""
    user = [c for c in df.columns if not c.startswith(INTERNAL_PREFIX)]
    internal = [c for c in df.columns if c.startswith(INTERNAL_PREFIX)]
    return user, internal


def number_rows(df: DataFrame, partition_by: list[str], order_by: list[str], out: str = "_row_number",
                num_partitions: int | None = None) -> DataFrame:
    """WIN1: 1-based row number per ``partition_by`` group in ``order_by`` order, skew-safe."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in partition_by + order_by]
    written = materialize(df.withColumn("__id", F.monotonically_increasing_id()), "row_numbers")
    ranged = materialize(
        written.select("__id", *dict.fromkeys(partition_by + order_by)).repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("__pid", F.spark_partition_id())
        .withColumn("__pos", F.monotonically_increasing_id()),
        "row_numbers",
    )
    slices = ranged.groupBy("__pid", *partition_by).agg(
        F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    before = Window.partitionBy(*partition_by).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    slices = slices.select(F.col("__pid").alias("__spid"), *[F.col(c).alias(f"__s_{c}") for c in partition_by],
                           "__first", "__offset")
    # null-safe on the group columns: rows whose group is null are numbered too, never dropped
    cond = [F.col("__pid") == F.col("__spid")] + [F.col(c).eqNullSafe(F.col(f"__s_{c}")) for c in partition_by]
    numbers = ranged.join(slices, cond).select(
        "__id", (F.col("__pos") - F.col("__first") + F.col("__offset") + F.lit(1)).cast("bigint").alias(out))
    return written.join(numbers, "__id").drop("__id")


def add_provenance(df: DataFrame, dataset_id: Column | str, source_file: Column | str,
                   source_type: Column | str, order_by: list[str], ingested_at: str | None = None,
                   content_col: str | None = "content") -> DataFrame:
    """PRJ5: ``_source_file``, ``_source_type``, ``_row_number`` (1-based per dataset),
    ``_dataset_id``, ``_ingested_at`` (a parameter, never now()) and, when a content column
    exists, ``_content_hash`` (md5 of the whole text)."""

    def as_col(v):
        return v if isinstance(v, Column) else F.lit(v)

    out = df.withColumns({
        "_dataset_id": as_col(dataset_id),
        "_source_file": as_col(source_file),
        "_source_type": as_col(source_type),
    })
    out = number_rows(out, ["_dataset_id"], order_by)
    if ingested_at is not None:
        out = out.withColumn("_ingested_at", F.lit(ingested_at))
    if content_col and content_col in df.columns:
        out = out.withColumn("_content_hash", content_hash(content_col))
    return out


def duplicate_content(df: DataFrame, hash_col: str, key: str, text_col: str | None = None) -> DataFrame:
    """AGG17: groups of rows sharing a content hash: count, first row key, member count > 1.

    Aggregates with partial (map-side) aggregation, so a hash shared by a third
    of all rows is pre-reduced on every executor before the shuffle; no member
    list is collected.
    """
    grouped = df.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(
        F.count(F.lit(1)).alias("copies"),
        F.min(key).alias("first_key"),
        F.max(key).alias("last_key"),
        *([F.max(F.length(text_col)).alias("chars")] if text_col else []),
    )
    return grouped.where(F.col("copies") > 1)

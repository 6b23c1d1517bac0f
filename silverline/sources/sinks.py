"""Writers (SNK1, SNK2).

Datasets are stored as one Parquet directory partitioned by ``_dataset_id``
with dynamic partition overwrite: re-ingesting a dataset replaces only its
own partition, and readers prune partitions by dataset id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_dataset(df: DataFrame, root: str, partition_col: str = "_dataset_id", mode: str = "overwrite") -> str:
    """SNK1: write rows under ``root`` partitioned by dataset; only touched partitions are replaced.

    Rows are range-clustered by (dataset, row number) - or (dataset, content hash) when
    there is no row number - so each task writes a contiguous slice of few datasets, and a
    dataset holding a third of all rows is split over many tasks instead of one.
    """
    second = F.col("_row_number") if "_row_number" in df.columns else F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    (df.repartitionByRange(F.col(partition_col), second)
       .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(partition_col).parquet(root))
    return root


def write_gold(df: DataFrame, gold_tables: DataFrame, gold_columns: DataFrame, root: str, table_name: str) -> dict:
    """SNK2: write a gold table and its metadata rows (tables and columns); a second promotion replaces both.

    ``table_name`` is a sanitized name; each table's metadata is one ``promoted=<table_name>`` folder.
    """
    path, meta = f"{root.rstrip('/')}/tables/{table_name}", f"{root.rstrip('/')}/meta"
    df.write.mode("overwrite").parquet(path)
    tables = gold_tables.withColumn("parquet_path", F.lit(path)).withColumn("is_queryable", F.lit(True))
    tables.write.mode("overwrite").parquet(f"{meta}/gold_tables/promoted={table_name}")
    gold_columns.write.mode("overwrite").parquet(f"{meta}/gold_columns/promoted={table_name}")
    return {"path": path, "tables": f"{root}/meta/gold_tables", "columns": f"{root}/meta/gold_columns"}

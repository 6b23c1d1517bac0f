"""Catalog, gold layer metadata and SQL surface (CAT1-CAT5, CAT9, JOIN3, JOIN6-8, WIN3, WIN4, SRT1,
LIM1, LIM3, AGG12, AGG20, CTX3).

Promotion metadata for MANY datasets is computed in one grouped aggregation
(``promote_all``): every (dataset, column) pair is profiled in the same pass.
Listings use windows partitioned by small keys (space, user) with a row limit,
which Spark evaluates with a per-partition group limit before the shuffle.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from silverline.functions import patterns as P
from silverline.functions import types as TY
from silverline.operators import profile as PR
from silverline.session import materialize


# ---------------------------------------------------------------------------
# SQL surface
# ---------------------------------------------------------------------------


def run_sql(spark: SparkSession, sql: str, limit: int | None = None) -> DataFrame:
    """CAT2: run SQL text through Catalyst; ``limit`` caps the rows with ``.limit`` (never by
    appending text, which breaks statements that already have LIMIT or a trailing ``;``)."""
    df = spark.sql(sql.strip().rstrip(";"))
    return df.limit(limit) if limit is not None else df


def run_sql_logged(spark: SparkSession, sql: str, user_id: str, limit: int | None = None,
                   executed_at: str | None = None) -> tuple[DataFrame | None, DataFrame]:
    """CAT2 with a query-history row (text, ms, rows, status, error)."""
    t0 = time.time()
    try:
        df = materialize(run_sql(spark, sql, limit), "sql-result")  # every column is computed, once
        rows = df.count()
        status, error = "success", None
    except Exception as e:  # noqa: BLE001 - the error text is the logged outcome
        df, rows, status, error = None, 0, "error", str(e)
    ms = int((time.time() - t0) * 1000)
    log = spark.createDataFrame(
        [(user_id, sql, status, error, ms, rows, executed_at)],
        "user_id string, query_text string, status string, error_message string, execution_time_ms int, "
        "row_count bigint, created_at string",
    ).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    return df, log


def register_views(tables: dict[str, DataFrame]) -> list[str]:
    """CAT1: register each table under its view name (spaces -> ``_``, lower case).

    Two tables mapping to the same view name are rejected instead of silently replaced.
    """
    from silverline.operators.columns import view_name

    names: dict[str, str] = {}
    for name in tables:
        v = view_name(name)
        if v in names:
            raise ValueError(f"view name collision: {name!r} and {names[v]!r} -> {v!r}")
        names[v] = name
    for v, name in names.items():
        tables[name].createOrReplaceTempView(v)
    return list(names)


def list_tables(datasets: DataFrame) -> DataFrame:
    """CAT9: view name, original name, rows and file type of each dataset."""
    return datasets.select(
        F.lower(F.replace(F.col("name"), F.lit(" "), F.lit("_"))).alias("view_name"),
        F.col("name").alias("original_name"), "row_count", "file_type", "status")


# ---------------------------------------------------------------------------
# Gold layer
# ---------------------------------------------------------------------------


def promote_all(df: DataFrame, dataset_col: str, samples: int = 0) -> tuple[DataFrame, DataFrame]:
    """CAT3 + CAT4 for every dataset in ``df`` at once: (gold_tables, gold_columns).

    Profiles user columns only (internal ``_`` columns are carried, not scored).
    gold_columns: dataset, column, semantic type, SQL type, nullable, valid %; with ``samples``, also ``sample_values``,
    that many of the smallest distinct invalid values as a JSON array (``[]`` where all are valid).
    gold_tables: dataset, rows, columns, score, level.
    """
    user = [c for c in df.columns if not c.startswith("_") and c != dataset_col]
    v = PR.validate_columns(df, columns=user, group_by=[dataset_col])
    if samples:
        v = materialize(v, "gold-profile")  # the profile is read three times, made once
    columns = v.select(
        F.col(dataset_col).alias("dataset_id"), "ordinal", "column_name",
        F.col("expected_type").alias("column_type"), TY.sql_type(F.col("expected_type")).alias("sql_type"),
        (F.col("null_count") > 0).alias("is_nullable"), F.lit(False).alias("is_primary_key"),
        "valid_percentage",
    )
    if samples:
        found = PR.smallest_invalid(df.select(*[F.col(f"`{c}`") for c in [dataset_col, *user]]), v, [dataset_col], samples).select(
            F.col(f"`{dataset_col}`").alias("__dataset"), F.col("column_name").alias("__column"), F.to_json("sample_values").alias("sample_values"))
        same = F.col("dataset_id").eqNullSafe(F.col("__dataset")) & (F.col("column_name") == F.col("__column"))
        columns = (columns.join(found, same, "left").drop("__dataset", "__column")
                   .withColumn("sample_values", F.coalesce("sample_values", F.lit("[]"))))
    tables = PR.table_quality(v, group_by=[dataset_col]).select(
        F.col(dataset_col).alias("dataset_id"), F.col("total_rows").alias("row_count"),
        F.col("total_columns").alias("column_count"), F.col("overall_score").alias("quality_score"),
        "quality_level",
    )
    return tables, columns


def promote(df: DataFrame, table_name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """CAT5 for one table: infer -> validate -> score -> typed cleaning (unless bronze below 50).

    Returns (gold rows, gold_tables row, gold_columns rows).  The per-column types reach the
    driver as one small row per column; the data itself is transformed in one ``select``.
    """
    user = [c for c in df.columns if not c.startswith("_")]  # provenance columns are neither scored nor rewritten
    profiled = PR.validate_columns(df.select(*[F.col(f"`{c}`") for c in user]))
    # one scan: the validation has one row per column, so it is collected once and the
    # quality and metadata frames are derived from that small local copy
    v = df.sparkSession.createDataFrame(profiled.collect(), profiled.schema)
    q = PR.table_quality(v, table_name)
    qrow = q.select("overall_score", "quality_level").first()
    types = {r["column_name"]: r["expected_type"] for r in v.select("column_name", "expected_type").collect()}
    clean = qrow["quality_level"] != "bronze" or qrow["overall_score"] >= 50
    if clean:
        out = df.select(*[
            (TY.apply_typed(F.col(f"`{c}`"), types.get(c, "text")) if c in user and isinstance(df.schema[c].dataType, T.StringType)
             else F.col(f"`{c}`")).alias(c)
            for c in df.columns
        ])
    else:
        out = df
    tables = q.select(F.lit(table_name).alias("table_name"), F.col("total_rows").alias("row_count"),
                      F.col("total_columns").alias("column_count"), F.col("overall_score").alias("quality_score"),
                      "quality_level")
    columns = v.select(F.lit(table_name).alias("table_name"), "ordinal", "column_name",
                       F.col("expected_type").alias("column_type"), TY.sql_type(F.col("expected_type")).alias("sql_type"),
                       (F.col("null_count") > 0).alias("is_nullable"), "valid_percentage")
    return out, tables, columns


def promotion_summary(gold_tables: DataFrame, group_col: str = "space_id") -> DataFrame:
    """AGG12: per group: mean score (2 decimals), level of the mean, table count, total rows."""
    agg = gold_tables.groupBy(group_col).agg(
        F.avg("quality_score").alias("__avg"), F.count(F.lit(1)).alias("total_tables"),
        F.sum("row_count").cast("bigint").alias("total_rows"))
    return agg.select(group_col, F.round("__avg", 2).alias("average_score"),
                      PR.level_expr(F.col("__avg")).alias("quality_level"), "total_tables", "total_rows")


def gold_listing(gold_tables: DataFrame) -> DataFrame:
    """AGG20: per space: gold tables, rows, mean quality."""
    return gold_tables.groupBy("space_id").agg(
        F.count(F.lit(1)).alias("tables"), F.sum("row_count").cast("bigint").alias("rows"),
        F.round(F.avg("quality_score"), 2).alias("avg_quality"))


def tables_with_columns(gold_tables: DataFrame, gold_columns: DataFrame) -> DataFrame:
    """JOIN3: gold table -> its columns (equi-join on the table id)."""
    return gold_tables.join(gold_columns, "dataset_id")


def schema_context(gold_tables: DataFrame, gold_columns: DataFrame, name_col: str = "table_name") -> DataFrame:
    """CTX3: per table "Table: t" followed by "  col: TYPE" lines in column order.

    The per-table list is bounded by the column count; tables are processed in parallel.
    """
    cols = gold_columns.groupBy("dataset_id").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", F.format_string("  %s: %s", "column_name", "sql_type")
                                              .alias("line")))).alias("__lines"))
    t = gold_tables.join(cols, "dataset_id", "left")
    return t.select(
        "dataset_id", "space_id",
        F.concat(F.lit("Table: "), F.col(name_col), F.lit("\n"),
                 F.coalesce(F.array_join(F.transform("__lines", lambda x: x["line"]), "\n"),
                            F.lit("  (no columns)"))).alias("schema_context"),
    )


def not_promoted(datasets: DataFrame, gold_tables: DataFrame) -> DataFrame:
    """JOIN6: datasets with no gold table yet (anti-join)."""
    return datasets.join(gold_tables.select(F.col("dataset_id").alias("id")), "id", "left_anti")


def upsert(current: DataFrame, updates: DataFrame, key: str, version_col: str) -> DataFrame:
    """JOIN7: latest version per key wins; rows of keys that are not updated stay.

    ``max_by`` in a ``groupBy`` (partial aggregation): every executor keeps only its latest
    version of each key before the shuffle, so even a key with very many versions costs one
    row per partition.
    """
    both = current.unionByName(updates, allowMissingColumns=True)
    cols = [c for c in both.columns if c != key]
    latest = both.groupBy(key).agg(
        F.max_by(F.struct(*[F.col(f"`{c}`") for c in cols]),
                 # null versions are the oldest, but a key that has only such keeps its values
                 F.struct(F.col(version_col).isNotNull().alias("known"), F.col(version_col).alias("version"))).alias("__r"))
    return latest.select(key, *[F.col(f"__r.`{c}`").alias(c) for c in cols])


def cascade_delete(parents: DataFrame, children: DataFrame, deleted: DataFrame, parent_key: str,
                   child_fk: str) -> tuple[DataFrame, DataFrame]:
    """JOIN8: remove deleted parents and every child pointing at them (anti-joins)."""
    gone = deleted.select(F.col(parent_key).alias("__k")).distinct()
    p = parents.join(gone, parents[parent_key] == gone["__k"], "left_anti")
    c = children.join(gone, children[child_fk] == gone["__k"], "left_anti")
    return p, c


def newest_per_group(df: DataFrame, group_cols: str | list[str], order_cols: list, n: int) -> DataFrame:
    """WIN3/LIM3/WIN4: the first ``n`` rows per group in ``order_cols`` order.

    ``row_number() <= n`` lets Spark insert a per-partition group limit before the
    shuffle, so a hot group sends at most ``n`` rows per input partition.
    """
    groups = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    w = Window.partitionBy(*groups).orderBy(*order_cols)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def preview(df: DataFrame, order_cols: list, n: int) -> DataFrame:
    """LIM1: first ``n`` rows in a stated order plus the table's total row count on each row.

    The page (``n`` rows, a top-k) and the count (one row) are both bounded, so a
    whole-frame window over their union attaches the total without a join.
    """
    page = df.orderBy(*order_cols).limit(n).withColumn("__page", F.lit(True))
    total = df.agg(F.count(F.lit(1)).alias("total_rows")).withColumn("__page", F.lit(False))
    both = page.unionByName(total, allowMissingColumns=True)
    return (both.withColumn("total_rows", F.max("total_rows").over(Window.partitionBy()))
            .where(F.col("__page")).drop("__page"))


def sql_type_map(semantic: str) -> str:
    return dict(P.SEMANTIC_SQL_TYPES).get(semantic, P.DEFAULT_SQL_TYPE)

"""Integrity checks of a cleaning run (AGG7-AGG11).

All checks compare a table before and after cleaning with aggregates; when
both sides are columns of the same rows (cleaning is a projection) the
comparison is a single-pass ``count_if`` with null-safe equality - no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silverline.functions import patterns as P


def change_counts(df: DataFrame, pairs: list[tuple[str, str, str]], action: str) -> DataFrame:
    """AGG7: rows changed per column by one step.

    ``pairs`` = (column name, before column, after column) on the same rows.
    Output: action, column, rows_affected (null-safe: null -> null is unchanged).
    """
    aggs = [F.count_if(~F.col(b).eqNullSafe(F.col(a))).cast("bigint").alias(f"__{i}")
            for i, (_, b, a) in enumerate(pairs)]
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(action).alias("action"), F.lit(name).alias("column"), F.col(f"__{i}").alias("rows_affected"))
        for i, (name, _, _) in enumerate(pairs)
    ])))


def _row_md5(df: DataFrame, columns: list[str] | None = None) -> Column:
    cols = columns or df.columns
    # \u001f separates fields; "\u0001" marks null so (null, "") and ("", null) differ
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0001")) for c in cols]
    return F.md5(F.concat_ws("\u001f", *parts))


def table_fingerprint(df: DataFrame, columns: list[str] | None = None, method: str = "md5") -> DataFrame:
    """AGG8: order-insensitive digest: row count + a sum of per-row hashes.

    ``md5`` (portable, the DuckDB twin computes the same): first 8 hex digits of each
    row's md5.  ``xxhash64`` (faster, Spark only): each row's xxhash64, summed exactly as a
    decimal.  A sum is associative, so the digest uses partial aggregation and is unchanged
    by any repartitioning or row order; unlike XOR, duplicate rows do not cancel out.
    """
    if method == "xxhash64":
        cols = [F.col(f"`{c}`") for c in (columns or df.columns)]
        part = F.xxhash64(*cols).cast("decimal(38,0)")
        return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(part).alias("digest")).select(
            "rows", F.col("digest").cast("string").alias("digest"),
            F.concat_ws(":", F.col("rows").cast("string"), F.col("digest").cast("string")).alias("fingerprint"))
    h = _row_md5(df, columns)
    part = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(part.cast("decimal(38,0)")).alias("digest")).select(
        "rows", "digest", F.concat_ws(":", F.col("rows").cast("string"), F.col("digest").cast("string")).alias("fingerprint")
    )


def _non_null_cells(df: DataFrame) -> Column:
    terms = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        present = c.isNotNull()
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            present = present & ~F.isnan(c)
        terms.append(present.cast("bigint"))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.sum(total)


def table_counts(df: DataFrame) -> DataFrame:
    """rows, columns, non-null cells of one table (one pass)."""
    if not df.columns:
        return df.agg(F.count(F.lit(1)).alias("rows")).withColumns({"columns": F.lit(0), "non_null": F.lit(0).cast("bigint")})
    return df.agg(F.count(F.lit(1)).alias("rows"), _non_null_cells(df).cast("bigint").alias("non_null")).withColumn(
        "columns", F.lit(len(df.columns)))


def data_loss_check(before: DataFrame, after: DataFrame, tolerance: float = 0.99) -> DataFrame:
    """AGG9: row count, column count, non-null cells before/after; loss flags and warnings."""
    b = table_counts(before).select(*[F.col(c).alias(f"original_{c}") for c in ["rows", "columns", "non_null"]])
    a = table_counts(after).select(*[F.col(c).alias(f"cleaned_{c}") for c in ["rows", "columns", "non_null"]])
    both = _side_by_side(b, a)
    rows_lost = F.col("cleaned_rows") < F.col("original_rows")
    cols_lost = F.col("cleaned_columns") < F.col("original_columns")
    return both.select(
        "*",
        (rows_lost | cols_lost).alias("data_loss"),
        F.array_compact(F.array(
            F.when(rows_lost, F.format_string(P.MESSAGES["err_rows"], F.col("original_rows"),
                                              F.col("cleaned_rows"), F.col("original_rows") - F.col("cleaned_rows"))),
            F.when(cols_lost, F.format_string(P.MESSAGES["err_columns"], F.col("original_columns"),
                                              F.col("cleaned_columns"))),
        )).alias("errors"),
        F.array_compact(F.array(
            F.when(F.col("cleaned_non_null") < F.col("original_non_null") * F.lit(tolerance),
                   F.format_string(P.MESSAGES["warn_non_null"], F.col("original_non_null"),
                                   F.col("cleaned_non_null"))),
        )).alias("warnings"),
    )


def _side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Put two one-row frames side by side (both are single aggregates; no join needed)."""
    return left.unionByName(right, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in left.columns + right.columns]
    )


def integrity_report(before: DataFrame, after: DataFrame, actions: int = 0,
                     extra_warnings: DataFrame | None = None) -> DataFrame:
    """AGG10: one row: counts, data_loss, integrity_score = cleaned/original * 100,
    before/after fingerprints, actions taken, warnings, errors."""
    loss = data_loss_check(before, after)
    fb = table_fingerprint(before).select(F.col("fingerprint").alias("original_hash"))
    fa = table_fingerprint(after).select(F.col("fingerprint").alias("cleaned_hash"))
    rep = _side_by_side(_side_by_side(loss.drop("errors", "warnings"), fb), fa)
    rep = _side_by_side(rep, loss.select("errors", "warnings"))
    score = F.when(F.col("original_rows") > 0, F.col("cleaned_rows") * F.lit(100.0) / F.col("original_rows")) \
        .otherwise(F.lit(100.0))
    return rep.select(
        "original_rows", "cleaned_rows", "data_loss", score.alias("integrity_score"),
        F.lit(actions).alias("actions_taken"), "warnings", "errors", "original_hash", "cleaned_hash",
    )


def verify_extraction(source: DataFrame, extracted: DataFrame, kind: str) -> DataFrame:
    """AGG11: extraction accuracy.

    tabular: rows and columns equal -> 100, else min/max rows * 100;
    json: verified when extracted rows >= 95 % of source items, accuracy = min(100, ratio*100);
    text: verified when the extracted text has more than 100 characters.
    """
    if kind == "text":
        txt = extracted.agg(
            F.count(F.lit(1)).alias("extracted_rows"),
            F.sum(F.length(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in extracted.columns]))).alias("chars"),
        )
        # rows are joined by one space as well
        txt = txt.withColumn("extracted_characters",
                             (F.coalesce(F.col("chars"), F.lit(0)) + F.greatest(F.col("extracted_rows") - 1, F.lit(0))).cast("bigint"))
        return txt.select((F.col("extracted_characters") > 100).alias("verified"), "extracted_characters", "extracted_rows")
    s = source.agg(F.count(F.lit(1)).alias("original_rows")).withColumn("original_cols", F.lit(len(source.columns)))
    e = extracted.agg(F.count(F.lit(1)).alias("extracted_rows")).withColumn("extracted_cols", F.lit(len(extracted.columns)))
    both = _side_by_side(s, e)
    if kind == "json":
        ratio = F.col("extracted_rows") / F.greatest(F.col("original_rows"), F.lit(1))
        return both.select(
            (F.col("extracted_rows") >= F.col("original_rows") * F.lit(0.95)).alias("verified"),
            F.col("original_rows").alias("original_items"), "extracted_rows",
            F.least(F.lit(100.0), ratio * 100).alias("accuracy"))
    same = (F.col("original_rows") == F.col("extracted_rows")) & (F.col("original_cols") == F.col("extracted_cols"))
    acc = F.when(same, F.lit(100.0)).otherwise(
        F.least("extracted_rows", "original_rows") * F.lit(100.0)
        / F.greatest(F.col("extracted_rows"), F.col("original_rows"), F.lit(1)))
    return both.select(same.alias("verified"), "original_rows", "extracted_rows", "original_cols", "extracted_cols",
                       acc.alias("accuracy"))

"""Column profiling, type inference, validation and quality scoring.

TYP1 detect_column_type, TYP2 infer_semantic_types, TYP3 coerce_columns,
TYP4 infer_types, AGG1 anomaly_report, AGG2 validate_columns, AGG3
invalid_samples, AGG4 table_quality, AGG5 recommendations, AGG6
low_quality_table, AGG21 data_completeness.

Plan shape: every statistic of every column is computed in ONE aggregation
(partial aggregation on each executor, a single-row final merge), chunked by
columns so the generated code stays small; Parquet column pruning means the
chunks together still read each column once.  The one-row result is unpivoted
to one row per column with ``inline`` and stays a DataFrame.  Ratios are taken
over all non-null values (deterministic), not over the reference's first 100.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from silverline.functions import patterns as P
from silverline.functions import sqltext as Q
from silverline.functions import types as TY

CHUNK_COLUMNS = 40
STAT_FIELDS = ["non_null", "m_numeric", "m_date", "m_phone", "m_email", "m_money",
               "v_numeric", "v_date", "v_phone", "v_email", "v_money",
               "d_numeric", "d_date1", "d_date2", "long_count", "blank_count"]


def _is_string(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def _column_stats(name: str, dtype: T.DataType) -> Column:
    """One struct of aggregates describing a column (same field layout for every column).

    Written as SQL text so a wide table costs one call per column to build.
    """
    c = Q.ident(name)
    present = f"({c} IS NOT NULL AND NOT isnan({c}))" if isinstance(dtype, (T.FloatType, T.DoubleType)) \
        else f"({c} IS NOT NULL)"
    if _is_string(dtype):
        st = Q.strip(c)
        no_comma = Q.drop(c, ",")
        fields = {
            # inference (values as stored, reference's samples are not stripped)
            "m_numeric": Q.count_if(Q.rlike(no_comma, P.DETECT_NUMERIC)),
            "m_date": Q.count_if(Q.rlike(c, P.VALIDATOR_PATTERNS["date_vn"])),
            "m_phone": Q.count_if(Q.rlike(c, P.VALIDATOR_PATTERNS["phone"])),
            "m_email": Q.count_if(Q.rlike(c, P.VALIDATOR_PATTERNS["email"])),
            "m_money": Q.count_if(Q.rlike(c, P.VALIDATOR_PATTERNS["money_vn"])),
            # validity per candidate type (values stripped)
            "v_numeric": Q.count_if(f"({Q.plain_number(Q.drop(st, ',', ' '))}) IS NOT NULL"),
            "v_date": Q.count_if(Q.rlike(st, P.VALIDATOR_PATTERNS["date_vn"])),
            "v_phone": Q.count_if(Q.rlike(st, P.VALIDATOR_PATTERNS["phone"])),
            "v_email": Q.count_if(Q.rlike(st, P.VALIDATOR_PATTERNS["email"])),
            "v_money": Q.count_if(Q.rlike(st, P.VALIDATOR_PATTERNS["money_vn"])),
            # cleaner's detection (TYP1): drop "," and " " before the numeric test
            "d_numeric": Q.count_if(Q.rlike(Q.drop(c, ",", " "), P.DETECT_NUMERIC)),
            "d_date1": Q.count_if(Q.rlike(c, P.DETECT_DATES[0])),
            "d_date2": Q.count_if(Q.rlike(c, P.DETECT_DATES[1])),
            # anomalies
            "long_count": Q.count_if(f"length({c}) > {P.LONG_STRING_CHARS}"),
            "blank_count": Q.count_if(f"coalesce({st} = '', false)"),
        }
    else:
        fields = {"d_numeric": Q.count_if(f"{present} AND {Q.rlike(Q.drop(f'CAST({c} AS STRING)', ','), P.DETECT_NUMERIC)}")}
    fields["non_null"] = Q.count_if(present)
    body = ", ".join(f"{Q.lit(k)}, {fields.get(k, 'CAST(0 AS BIGINT)')}" for k in STAT_FIELDS)
    return F.expr(f"named_struct({body})")


def column_stats(df: DataFrame, columns: list[str] | None = None, group_by: list[str] | None = None) -> DataFrame:
    """Long table, one row per (group, column): counts for type inference, validity and anomalies.

    Columns: [group_by...], ordinal, column_name, actual_type, dtype_semantic, total_rows, non_null,
    m_*, v_*, d_*, long_count, blank_count.  With ``group_by`` every group (e.g. every dataset)
    is profiled in the same single aggregation.
    """
    group_by = group_by or []
    fields = [f for f in df.schema.fields
              if (columns is None or f.name in columns) and f.name not in group_by]
    if not fields:
        schema = ("ordinal int, column_name string, actual_type string, dtype_semantic string, total_rows bigint, "
                  "non_null bigint")
        return df.sparkSession.createDataFrame([], schema)
    chunks = [fields[i:i + CHUNK_COLUMNS] for i in range(0, len(fields), CHUNK_COLUMNS)]
    parts = []
    offset = 0
    for chunk in chunks:
        aggs = [F.count(F.lit(1)).alias("__rows")]
        aggs += [_column_stats(f.name, f.dataType).alias(f"__c{i}") for i, f in enumerate(chunk)]
        one = df.groupBy(*group_by).agg(*aggs)
        rows = F.array(*[
            F.struct(
                F.lit(offset + i).alias("ordinal"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("actual_type"),
                F.lit(TY.semantic_of_dtype(f.dataType)).cast("string").alias("dtype_semantic"),
                F.col("__rows").alias("total_rows"),
                F.col(f"__c{i}.*"),
            )
            for i, f in enumerate(chunk)
        ])
        parts.append(one.select(*group_by, F.inline(rows)))
        offset += len(chunk)
    return reduce(DataFrame.unionByName, parts)


def _ratio_over(col: str, share: float) -> Column:
    return F.col(col) > F.col("non_null") * F.lit(share)


def semantic_type_expr() -> Column:
    """TYP2 decision over ``column_stats`` columns (dtype first, then > 70 % patterns)."""
    share = P.INFER_SHARE
    return (
        F.when(F.col("non_null") == 0, F.lit("unknown"))
        .when(F.col("dtype_semantic").isNotNull(), F.col("dtype_semantic"))
        .when(_ratio_over("m_numeric", share), F.lit("numeric"))
        .when(_ratio_over("m_date", share), F.lit("date"))
        .when(_ratio_over("m_phone", share), F.lit("phone"))
        .when(_ratio_over("m_email", share), F.lit("email"))
        .when(_ratio_over("m_money", share), F.lit("money"))
        .otherwise(F.lit("text"))
    )


def detected_type_expr() -> Column:
    """TYP1 decision of the cleaner: numeric, date, text or unknown."""
    share = P.INFER_SHARE
    return (
        F.when(F.col("non_null") == 0, F.lit("unknown"))
        .when(_ratio_over("d_numeric", share), F.lit("numeric"))
        .when(_ratio_over("d_date1", share) | _ratio_over("d_date2", share), F.lit("date"))
        .otherwise(F.lit("text"))
    )


def infer_semantic_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """TYP2: (ordinal, column_name, expected_type) per column."""
    return column_stats(df, columns).select("ordinal", "column_name", semantic_type_expr().alias("expected_type"))


def detect_column_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """TYP1: (ordinal, column_name, detected_type) per column."""
    return column_stats(df, columns).select("ordinal", "column_name", detected_type_expr().alias("detected_type"))


def validate_columns(df: DataFrame, expected_schema: dict[str, str] | None = None,
                     columns: list[str] | None = None, group_by: list[str] | None = None) -> DataFrame:
    """AGG2: per column expected/actual type, valid/invalid/null counts, valid % and issues.

    valid % = valid non-null values / all rows * 100 (nulls lower the score).
    ``expected_schema`` overrides the inferred type of named columns.
    """
    group_by = group_by or []
    stats = column_stats(df, columns, group_by)
    expected = semantic_type_expr()
    if expected_schema:
        override = F.lit(None).cast("string")
        for name, typ in expected_schema.items():
            override = F.when(F.col("column_name") == name, F.lit(typ)).otherwise(override)
        expected = F.coalesce(override, expected)
    stats = stats.withColumn("expected_type", expected)
    is_string = F.col("dtype_semantic").isNull()
    et = F.col("expected_type")
    valid = (
        F.when(~is_string, F.col("non_null"))
        .when(et == "numeric", F.col("v_numeric"))
        .when(et == "date", F.col("v_date"))
        .when(et == "phone", F.col("v_phone"))
        .when(et == "email", F.col("v_email"))
        .when(et == "money", F.col("v_money"))
        .otherwise(F.col("non_null"))
    )
    out = (
        stats.withColumn("valid_count", valid)
        .withColumn("null_count", F.col("total_rows") - F.col("non_null"))
        .withColumn("invalid_count", F.col("non_null") - F.col("valid_count"))
        .withColumn(
            "valid_percentage",
            F.when(F.col("total_rows") > 0, F.col("valid_count") * F.lit(100.0) / F.col("total_rows")).otherwise(F.lit(0.0)),
        )
    )
    issues = F.array_compact(F.array(
        F.when((et == "numeric") & (F.col("invalid_count") > 0),
               F.format_string(P.MESSAGES["not_numeric"], F.col("invalid_count"))),
        F.when(F.col("null_count") > F.col("total_rows") * F.lit(P.HIGH_NULL_SHARE),
               F.format_string(P.MESSAGES["high_nulls"], F.col("null_count"), F.col("total_rows"))),
    ))
    return out.select(
        *group_by, "ordinal", "column_name", "expected_type", "actual_type", "valid_count", "invalid_count",
        "null_count", "total_rows", "valid_percentage", issues.alias("issues"),
    )


def invalid_samples(df: DataFrame, validation: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """AGG3: the first ``n`` invalid values per column in ``order_by`` order.

    Unpivots only string columns (other types are always valid), joins the
    per-column expected type (one row per column: a bounded broadcast), and
    keeps ``row_number() <= n``; Spark inserts a per-partition group limit
    before the shuffle, so a column with many invalid values never sends more
    than ``n`` rows per partition.
    """
    string_cols = [f.name for f in df.schema.fields if _is_string(f.dataType) and f.name not in order_by]
    if not string_cols:
        return df.sparkSession.createDataFrame([], "column_name string, rank int, value string")
    cells = df.select(*[F.col(k) for k in order_by], F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("value")) for c in string_cols
    ])))
    types = F.broadcast(validation.select("column_name", "expected_type"))
    cells = cells.join(types, "column_name")
    valid = F.lit(True)
    for t in ["numeric", "integer", "date", "phone", "email", "money", "boolean"]:
        valid = F.when(F.col("expected_type") == t, TY.is_valid_for_type(F.col("value"), t)).otherwise(valid)
    bad = cells.where(F.col("value").isNotNull() & ~valid)
    w = F.row_number().over(Window.partitionBy("column_name").orderBy(*order_by))
    return bad.withColumn("rank", w).where(F.col("rank") <= n).select("column_name", "rank", "value")


def smallest_invalid(df: DataFrame, validation: DataFrame, group_by: list[str], n: int = 3) -> DataFrame:
    """AGG3 for all groups at once: [group_by...], column_name, sample_values (the ``n`` smallest distinct invalid values, in order).

    ``validation`` is that of ``validate_columns`` with the same ``group_by``; only columns with invalid values are looked
    at, so valid and free-text columns meet no pattern.  Repeated values are merged on the map side and dealt by value, so
    one frequent bad value is no hot key; the ranking keeps ``n`` values per partition before its shuffle.
    Groups and columns without invalid values have no row; rows of a null group take part.
    """
    strings = [f.name for f in df.schema.fields if _is_string(f.dataType) and f.name not in group_by]
    if not strings:
        keys = "".join(f"`{g}` {df.schema[g].dataType.simpleString()}, " for g in group_by)
        return df.sparkSession.createDataFrame([], f"{keys}column_name string, sample_values array<string>")
    cells = df.select(*[F.col(f"`{g}`") for g in group_by], F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("__value")) for c in strings])))
    types = validation.where("invalid_count > 0").select(
        *[F.col(f"`{g}`").alias(f"__g{i}") for i, g in enumerate(group_by)], F.col("column_name").alias("__column"), "expected_type")
    same = F.col("column_name") == F.col("__column")
    for i, g in enumerate(group_by):
        same &= F.col(f"`{g}`").eqNullSafe(F.col(f"__g{i}"))
    cells = cells.where(F.col("__value").isNotNull()).join(types, same)
    valid = F.lit(True)
    for t in ["numeric", "integer", "date", "phone", "email", "money", "boolean"]:
        valid = F.when(F.col("expected_type") == t, TY.is_valid_for_type(F.col("__value"), t)).otherwise(valid)
    keys = [*[F.col(f"`{g}`") for g in group_by], F.col("column_name")]
    bad = cells.where(~valid).select(*keys, "__value").distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__value"))
    return (bad.withColumn("__rank", rank).where(F.col("__rank") <= n).groupBy(*keys)
            .agg(F.sort_array(F.collect_list("__value")).alias("sample_values")))  # at most n values


def level_expr(score: Column) -> Column:
    return (F.when(score >= P.GOLD_MIN_SCORE, F.lit("gold"))
            .when(score >= P.SILVER_MIN_SCORE, F.lit("silver"))
            .otherwise(F.lit("bronze")))


def table_quality(validation: DataFrame, table_name: str = "table", group_by: list[str] | None = None) -> DataFrame:
    """AGG4: overall score = mean column valid %, level gold >= 95, silver >= 80, else bronze.

    One row (per group): table_name, total_rows, total_columns, overall_score, quality_level,
    issues (columns under 90 %, in column order).  The per-group list is bounded by the column count.
    """
    group_by = group_by or []
    agg = validation.groupBy(*group_by).agg(
        F.coalesce(F.avg("valid_percentage"), F.lit(0.0)).alias("overall_score"),
        F.count(F.lit(1)).alias("total_columns"),
        F.coalesce(F.max("total_rows"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.sort_array(F.collect_list(F.when(
            F.col("valid_percentage") < P.LOW_VALIDITY_ISSUE,
            F.struct("ordinal", F.format_string(P.MESSAGES["low_validity"], F.col("column_name"),
                                                F.col("valid_percentage")).alias("msg")),
        ))).alias("__issues"),
    )
    return agg.select(
        *group_by,
        F.lit(table_name).alias("table_name"),
        "total_rows",
        "total_columns",
        F.col("overall_score"),
        level_expr(F.col("overall_score")).alias("quality_level"),
        F.transform("__issues", lambda x: x["msg"]).alias("issues"),
    )


def recommendations(validation: DataFrame, quality: DataFrame) -> DataFrame:
    """AGG5: recommendation lines (score rules then column rules), one row each with an ordinal."""
    q = quality.select("overall_score", "total_rows")
    score_low = q.select(F.lit(0).alias("seq"), F.lit(-1).alias("ordinal"), F.when(
        F.col("overall_score") < P.REC_LOW_SCORE, F.lit(P.MESSAGES["rec_below_80"])
    ).alias("text"))
    col_rules = validation.select(F.lit(1).alias("seq"), F.col("ordinal"), F.explode(F.array_compact(F.array(
        F.when(F.col("null_count") > F.col("total_rows") * F.lit(P.REC_NULL_SHARE),
               F.format_string(P.MESSAGES["rec_fill_nulls"], F.col("column_name"))),
        F.when(F.col("invalid_count") > P.REC_INVALID_COUNT,
               F.format_string(P.MESSAGES["rec_needs_cleaning"], F.col("column_name"), F.col("invalid_count"))),
    ))).alias("text"))
    positive = q.select(F.lit(2).alias("seq"), F.lit(-1).alias("ordinal"), F.when(
        F.col("overall_score") >= P.GOLD_MIN_SCORE, F.lit(P.MESSAGES["rec_excellent"])
    ).when(F.col("overall_score") >= P.REC_GOOD_SCORE, F.lit(P.MESSAGES["rec_good"])).alias("text"))
    return score_low.unionByName(col_rules).unionByName(positive).where(F.col("text").isNotNull())


def anomaly_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """AGG1: per column null count/% , strings over 10,000 chars, blank strings; flags only."""
    st = column_stats(df, columns)
    null_count = F.col("total_rows") - F.col("non_null")
    null_pct = F.when(F.col("total_rows") > 0, null_count * F.lit(100.0) / F.col("total_rows")).otherwise(F.lit(0.0))
    warnings = F.array_compact(F.array(
        F.when(null_count > 0, F.format_string(P.MESSAGES["warn_nulls"], F.col("column_name"), null_count, null_pct)),
        F.when(F.col("long_count") > 0, F.format_string(P.MESSAGES["warn_long"], F.col("column_name"), F.col("long_count"))),
        F.when(F.col("blank_count") > 0, F.format_string(P.MESSAGES["warn_empty"], F.col("column_name"), F.col("blank_count"))),
    ))
    return st.select("ordinal", "column_name", null_count.alias("null_count"), null_pct.alias("null_pct"),
                     "long_count", "blank_count", warnings.alias("warnings"))


def low_quality_table(df: DataFrame) -> DataFrame:
    """AGG6: True when the first two names start with ``col_`` or the mean null share exceeds 0.4."""
    names = df.columns[:2]
    generic = bool(names) and all(n.startswith("col_") for n in names)
    if not df.columns:
        return df.sparkSession.createDataFrame([(True, None)], "low_quality boolean, mean_null_share double")
    st = column_stats(df)
    share = F.when(F.col("total_rows") > 0, (F.col("total_rows") - F.col("non_null")) / F.col("total_rows"))
    agg = st.agg(F.avg(share).alias("mean_null_share"))
    return agg.select(
        (F.lit(generic) | F.coalesce(F.col("mean_null_share") > P.LOW_QUALITY_NULL_SHARE, F.lit(False))).alias("low_quality"),
        "mean_null_share",
    )


def data_completeness(df: DataFrame) -> DataFrame:
    """AGG21: % of non-null cells in the table."""
    st = column_stats(df)
    return st.agg(
        F.sum("non_null").alias("non_null_cells"),
        F.sum("total_rows").alias("cells"),
    ).select(
        "non_null_cells", "cells",
        F.when(F.col("cells") > 0, F.col("non_null_cells") * F.lit(100.0) / F.col("cells")).otherwise(F.lit(0.0))
        .alias("completeness_pct"),
    )

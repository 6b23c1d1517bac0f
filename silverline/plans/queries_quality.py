"""Quality scorecard queries: type inference, validation, quality level (F1/F2 fixtures)."""

from __future__ import annotations

from pyspark.sql import functions as F

from silverline.functions import patterns as P
from silverline.operators import profile as PR
from silverline.plans import duck as D
from silverline.plans.fixtures import derived, duck_with
from silverline.plans.registry import register

# (name, spark type, dtype semantic or None for strings)
DIRTY_CUSTOMER_COLUMNS = [
    ("c_custkey", "bigint", "integer"),
    ("phone", "string", None),
    ("email", "string", None),
    ("balance_text", "string", None),
    ("segment", "string", None),
]
DIRTY_ORDERS_COLUMNS = [
    ("o_orderkey", "bigint", "integer"),
    ("date_text", "string", None),
    ("price_text", "string", None),
]


def _duck_stats(table: str, columns) -> str:
    return D.column_stats_sql(table, columns)


def _duck_validate(table: str, columns) -> str:
    return f"""
select ordinal, column_name, expected_type, actual_type, valid_count, invalid_count, null_count, total_rows,
  round(valid_percentage, 4) as valid_percentage,
  concat_ws('; ',
    case when expected_type = 'numeric' and invalid_count > 0
         then printf({D.q(P.MESSAGES['not_numeric'])}, invalid_count) end,
    case when null_count > total_rows * {P.HIGH_NULL_SHARE} then printf({D.q(P.MESSAGES['high_nulls'])}, null_count, total_rows) end
  ) as issues
from ({_duck_stats(table, columns)}) v"""


def _spark_validate(df):
    v = PR.validate_columns(df)
    return v.select(
        "ordinal", "column_name", "expected_type", "actual_type", "valid_count", "invalid_count", "null_count",
        "total_rows", F.round("valid_percentage", 4).alias("valid_percentage"),
        F.array_join("issues", "; ").alias("issues"),
    )


@register("quality_columns_dirty_customer", ["AGG2", "TYP2", "FLT4", "FLT5"],
          duck_with("dirty_customer") + _duck_validate("dirty_customer", DIRTY_CUSTOMER_COLUMNS))
def quality_columns_dirty_customer(spark, sf_dir):
    return _spark_validate(derived(spark, sf_dir, "dirty_customer"))


@register("quality_columns_dirty_orders", ["AGG2", "TYP2", "FLT5"],
          duck_with("dirty_orders") + _duck_validate("dirty_orders", DIRTY_ORDERS_COLUMNS))
def quality_columns_dirty_orders(spark, sf_dir):
    return _spark_validate(derived(spark, sf_dir, "dirty_orders"))


def _duck_quality(table: str, columns, name: str) -> str:
    return f"""
select {D.q(name)} as table_name, cast(coalesce(max(total_rows), 0) as bigint) as total_rows,
  count(*) as total_columns,
  round(coalesce(avg(valid_percentage), 0.0), 4) as overall_score,
  {D.level('coalesce(avg(valid_percentage), 0.0)')} as quality_level,
  coalesce(string_agg(case when valid_percentage < {P.LOW_VALIDITY_ISSUE}
           then printf({D.q(P.MESSAGES['low_validity'])}, column_name, valid_percentage) end, '; '
           order by ordinal), '') as issues
from ({_duck_stats(table, columns)}) v"""


def _spark_quality(df, name):
    q = PR.table_quality(PR.validate_columns(df), name)
    return q.select("table_name", "total_rows", "total_columns", F.round("overall_score", 4).alias("overall_score"),
                    "quality_level", F.array_join("issues", "; ").alias("issues"))


@register("quality_scorecard_dirty_customer", ["AGG4", "TYP2"],
          duck_with("dirty_customer") + _duck_quality("dirty_customer", DIRTY_CUSTOMER_COLUMNS, "dirty_customer"))
def quality_scorecard_dirty_customer(spark, sf_dir):
    return _spark_quality(derived(spark, sf_dir, "dirty_customer"), "dirty_customer")


@register("quality_scorecard_dirty_orders", ["AGG4"],
          duck_with("dirty_orders") + _duck_quality("dirty_orders", DIRTY_ORDERS_COLUMNS, "dirty_orders"))
def quality_scorecard_dirty_orders(spark, sf_dir):
    return _spark_quality(derived(spark, sf_dir, "dirty_orders"), "dirty_orders")


def flagship_scorecard(spark, sf_dir):
    """Per-column validation of ``dirty_customer`` with the table's score and level on every row."""
    from pyspark.sql.window import Window

    v = _spark_validate(derived(spark, sf_dir, "dirty_customer"))
    # the validation has one row per column, so a whole-frame window is bounded by the column count
    score = F.avg("valid_percentage").over(Window.partitionBy())
    return v.withColumn("table_score", F.round(score, 4)).withColumn("quality_level", PR.level_expr(score))

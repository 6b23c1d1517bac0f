"""Question routing and cache analysis (RTE1-RTE3) as batch jobs over a question table.

Intent scores are sums of ``rlike`` tests on the lower-cased question (pure
JVM expressions); routing attaches a per-space gold-table count (one row per
space: broadcast after a size check, else a salted join); cache statistics group by
(space, md5(lower(question))) with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silverline.functions import patterns as P
from silverline.functions.text import question_hash
from silverline.operators.joins import attach_per_key

INTENT_LISTS = {
    "numeric": P.NUMERIC_INTENT,
    "aggregate": P.AGGREGATE_INTENT,
    "list": P.LIST_INTENT,
    "lookup": P.LOOKUP_INTENT,
}


def intent_score(col, patterns: list[str]) -> Column:
    low = F.lower(F.col(col) if isinstance(col, str) else col)
    total = F.lit(0)
    for p in patterns:
        total = total + F.coalesce(low.rlike(P.py_to_portable(p)), F.lit(False)).cast("int")
    return total


def classify_intent(df: DataFrame, col: str) -> DataFrame:
    """RTE1: adds score_<intent> columns, ``intent`` and ``confidence``.

    Ties go aggregate > numeric > list > lookup; no hit -> general with 0.5;
    confidence = min(0.9, 0.5 + 0.1 * winning score), rounded to 2 decimals.
    """
    out = df.withColumns({f"score_{k}": intent_score(col, v) for k, v in INTENT_LISTS.items()})
    n, a, li, lo = (F.col(f"score_{k}") for k in ["numeric", "aggregate", "list", "lookup"])
    total = n + a + li + lo
    intent = (
        F.when(total == 0, F.lit("general"))
        .when(a >= F.greatest(n, li, lo), F.lit("aggregate"))
        .when(n >= F.greatest(li, lo), F.lit("numeric"))
        .when(li >= lo, F.lit("list"))
        .otherwise(F.lit("lookup"))
    )
    winning = (F.when(total == 0, F.lit(0))
               .when(intent == "aggregate", a).when(intent == "numeric", n)
               .when(intent == "list", li).otherwise(lo))
    conf = F.when(total == 0, F.lit(0.5)).otherwise(F.least(F.lit(0.9), F.lit(0.5) + winning * F.lit(0.1)))
    return out.withColumn("intent", intent).withColumn("confidence", F.round(conf, 2))


def route(questions: DataFrame, gold_tables: DataFrame, col: str = "question") -> DataFrame:
    """RTE2: sql when the space has gold tables and the intent is numeric/aggregate/lookup;
    list_documents when the intent is list and the text names documents; otherwise ai."""
    per_space = gold_tables.groupBy("space_id").agg(F.count(F.lit(1)).alias("gold_tables"))
    q = attach_per_key(classify_intent(questions, col), per_space, ["space_id"], how="left")
    has_gold = F.coalesce(F.col("gold_tables"), F.lit(0)) > 0
    decision = (
        F.when(has_gold & F.col("intent").isin("numeric", "aggregate", "lookup"), F.lit("sql"))
        .when((F.col("intent") == "list") & F.contains(F.lower(F.col(col)), F.lit(P.DOCUMENT_LIST_PHRASE)),
              F.lit("list_documents"))
        .otherwise(F.lit("ai"))
    )
    return q.withColumn("gold_tables", F.coalesce(F.col("gold_tables"), F.lit(0)).cast("bigint")) \
        .withColumn("route", decision)


def cache_stats(log: DataFrame, col: str = "question", order_cols: list[str] | None = None) -> DataFrame:
    """RTE3: per (space, question hash): times asked, cache hits (every ask after the first),
    first and last ask by ``order_cols`` (struct ordering)."""
    order = F.struct(*[F.col(c) for c in (order_cols or [])]) if order_cols else F.lit(0)
    return log.withColumn("query_hash", question_hash(col)).groupBy("space_id", "query_hash").agg(
        F.count(F.lit(1)).alias("asked"),
        (F.count(F.lit(1)) - 1).alias("hits"),
        F.min(order).alias("first_ask"),
        F.max(order).alias("last_ask"),
    )

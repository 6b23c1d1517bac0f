"""Usage metering and quotas (FLT3, FLT6, FLT7, FLT8, AGG13-15, AGG18-20, JOIN1, JOIN4, JOIN9, CAT7).

Every report is computed for ALL keys / users / spaces at once with one
``groupBy`` (partial aggregation before the shuffle, so a key that produced a
third of all requests is pre-reduced on every executor).  Time windows are
relative to an explicit ``as_of`` parameter, never ``now()``, so results are
reproducible.  The plan table has four fixed rows and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silverline.functions import patterns as P

MB = 1024 * 1024
LIMIT_COLUMNS = ["queries_per_month", "storage_mb", "rate_limit_per_minute"]


def _ts(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def scope_filter(df: DataFrame, **equals) -> DataFrame:
    """FLT3: tenant isolation by equality on any of user_id / api_key_id / space_id."""
    cond = F.lit(True)
    for col, val in equals.items():
        if val is not None:
            cond = cond & (F.col(col) == F.lit(val))
    return df.where(cond)


def recent(df: DataFrame, as_of: str, days: int, ts_col: str = "created_at") -> DataFrame:
    """FLT6: rows with ``ts_col >= as_of - days``."""
    return df.where(F.col(ts_col) >= _ts(as_of) - F.make_interval(days=F.lit(days)))


def month_start(as_of: str) -> Column:
    return F.date_trunc("month", _ts(as_of)).cast("timestamp_ntz")


def since_month_start(df: DataFrame, as_of: str, ts_col: str = "created_at") -> DataFrame:
    """FLT6 (month variant): rows since the first day of ``as_of``'s month."""
    return df.where(F.col(ts_col) >= month_start(as_of))


def key_usage(logs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """AGG13: per API key: total requests, total bytes, mean response time (2 decimals)."""
    return recent(logs, as_of, days).groupBy("api_key_id").agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.coalesce(F.sum("bytes_transferred"), F.lit(0)).cast("bigint").alias("total_bytes"),
        F.round(F.coalesce(F.avg("response_time_ms"), F.lit(0.0)), 2).alias("avg_response_time_ms"),
    )


def daily_usage(logs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """AGG14: per API key and day: requests, bytes, and queries (POST requests)."""
    return recent(logs, as_of, days).groupBy("api_key_id", F.to_date("created_at").alias("date")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.coalesce(F.sum("bytes_transferred"), F.lit(0)).cast("bigint").alias("bytes"),
    )


def plans_frame(spark: SparkSession) -> DataFrame:
    """The fixed plan table (four rows)."""
    return spark.createDataFrame(
        P.PLAN_LIMITS, "plan string, queries_per_month int, storage_mb int, rate_limit_per_minute int")


def with_plan_limits(df: DataFrame, plan_col: str = "plan") -> DataFrame:
    """JOIN4: attach ``plan_queries_per_month``, ``plan_storage_mb``, ``plan_rate_limit_per_minute``.

    Broadcast left join to the four fixed plan rows; an unknown or missing plan
    gets the default plan's limits (``effective_plan`` says which plan applied).
    """
    plans = plans_frame(df.sparkSession).select(
        F.col("plan").alias("__plan"),
        *[F.col(c).alias(f"plan_{c}") for c in LIMIT_COLUMNS])
    default = dict(zip(LIMIT_COLUMNS, [p for p in P.PLAN_LIMITS if p[0] == P.DEFAULT_PLAN][0][1:]))
    out = df.join(F.broadcast(plans), F.col(plan_col) == F.col("__plan"), "left")
    return out.withColumns({
        f"plan_{c}": F.coalesce(F.col(f"plan_{c}"), F.lit(v)) for c, v in default.items()
    }).withColumn("effective_plan", F.coalesce(F.col("__plan"), F.lit(P.DEFAULT_PLAN))).drop("__plan")


def monthly_usage(logs: DataFrame, history: DataFrame, datasets: DataFrame, users: DataFrame,
                  as_of: str) -> DataFrame:
    """AGG15: per user: requests and queries this month, storage MB (all time), period bounds."""
    start = month_start(as_of)
    req = since_month_start(logs, as_of).groupBy("user_id").agg(F.count(F.lit(1)).alias("requests"))
    qry = since_month_start(history, as_of).groupBy("user_id").agg(F.count(F.lit(1)).alias("queries"))
    sto = datasets.groupBy("user_id").agg(F.sum("file_size").alias("__bytes"))
    out = (users.select(F.col("id").alias("user_id"), "plan")
           .join(req, "user_id", "left").join(qry, "user_id", "left").join(sto, "user_id", "left"))
    return out.select(
        "user_id", "plan",
        F.coalesce("requests", F.lit(0)).cast("bigint").alias("requests"),
        F.coalesce("queries", F.lit(0)).cast("bigint").alias("queries"),
        F.round(F.coalesce(F.col("__bytes"), F.lit(0)) / F.lit(MB), 2).cast("double").alias("storage_mb"),
        start.alias("period_start"),
        F.add_months(start, 1).cast("timestamp_ntz").alias("period_end"),
    )


def quota_check(monthly: DataFrame) -> DataFrame:
    """JOIN9: queries_ok / storage_ok against the plan limits; the enterprise plan is unlimited."""
    m = with_plan_limits(monthly)
    unlimited = F.col("plan") == F.lit("enterprise")
    return m.select(
        "user_id", "plan", "effective_plan", "requests", "queries", "storage_mb",
        F.col("plan_queries_per_month").alias("queries_limit"),
        F.col("plan_storage_mb").alias("storage_limit_mb"),
        (unlimited | (F.col("queries") < F.col("plan_queries_per_month"))).alias("queries_ok"),
        (unlimited | (F.col("storage_mb") < F.col("plan_storage_mb"))).alias("storage_ok"),
    )


def active_keys(keys: DataFrame, as_of: str) -> DataFrame:
    """FLT8: active keys that are not past ``expires_at`` (null = never expires)."""
    return keys.where(F.col("is_active") & (F.col("expires_at").isNull() | (_ts(as_of) <= F.col("expires_at"))))


def keys_with_users(keys: DataFrame, users: DataFrame) -> DataFrame:
    """JOIN1: active keys joined to their user's plan (inner equi-join)."""
    return keys.where(F.col("is_active")).join(
        users.select(F.col("id").alias("user_id"), "plan"), "user_id", "inner")


def dataset_status(datasets: DataFrame) -> DataFrame:
    """FLT7: per space: ready (success) and processing file counts, error count."""
    return datasets.groupBy("space_id").agg(
        F.count_if(F.col("status") == "success").alias("ready_files"),
        F.count_if(F.col("status") == "processing").alias("processing_files"),
        F.count_if(F.col("status") == "error").alias("error_files"),
    )


def space_rollup(datasets: DataFrame) -> DataFrame:
    """AGG18: per space: file count, total size MB (2 decimals), total rows."""
    return datasets.groupBy("space_id").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.round(F.sum("file_size") / F.lit(MB), 2).alias("total_size_mb"),
        F.sum("row_count").cast("bigint").alias("total_rows"),
    )


def key_storage(datasets: DataFrame) -> DataFrame:
    """AGG19: per API key: storage used in MB, never below zero."""
    return datasets.groupBy("api_key_id").agg(
        F.greatest(F.lit(0.0), F.round(F.sum("file_size") / F.lit(MB), 2)).alias("storage_used_mb"),
        F.count(F.lit(1)).alias("datasets"),
    )


def query_log_stats(history: DataFrame) -> DataFrame:
    """CAT7: per user and day: runs, failures, rows returned, mean and median latency."""
    return history.groupBy("user_id", F.to_date("created_at").alias("date")).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("status") != "success").alias("failures"),
        F.sum("row_count").cast("bigint").alias("rows"),
        F.round(F.avg("execution_time_ms"), 2).alias("avg_ms"),
        F.percentile("execution_time_ms", 0.5).alias("median_ms"),
    )

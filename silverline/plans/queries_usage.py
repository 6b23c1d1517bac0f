"""Metering queries over the usage log, query history and dataset catalog derived from events/documents."""

from __future__ import annotations


from pyspark.sql import functions as F

from silverline.functions import patterns as P
from silverline.operators import usage as U
from silverline.plans.fixtures import derived, duck_with
from silverline.plans.registry import register
from silverline.session import materialize

AS_OF = "2024-01-31 00:00:00"
DAYS = 7
_SINCE = f"timestamp '{AS_OF}' - interval {DAYS} day"
_MONTH = "timestamp '2024-01-01 00:00:00'"
_PLANS = ("(values " + ", ".join(f"('{p}', {q}, {s}, {r})" for p, q, s, r in P.PLAN_LIMITS)
          + ") as p(plan, queries_per_month, storage_mb, rate_limit_per_minute)")


@register("key_usage_recent", ["AGG13", "FLT6"], duck_with("usage_logs") + f"""
select api_key_id, count(*) as total_requests, cast(coalesce(sum(bytes_transferred), 0) as bigint) as total_bytes,
  round(coalesce(avg(response_time_ms), 0.0), 2) as avg_response_time_ms
from usage_logs where created_at >= {_SINCE} group by api_key_id""")
def q_key_usage(spark, sf_dir):
    return U.key_usage(derived(spark, sf_dir, "usage_logs"), AS_OF, DAYS)


@register("daily_usage_recent", ["AGG14", "FLT6"], duck_with("usage_logs") + f"""
select api_key_id, cast(created_at as date) as date, count(*) as requests,
  cast(coalesce(sum(bytes_transferred), 0) as bigint) as bytes
from usage_logs where created_at >= {_SINCE} group by api_key_id, cast(created_at as date)""")
def q_daily_usage(spark, sf_dir):
    return U.daily_usage(derived(spark, sf_dir, "usage_logs"), AS_OF, DAYS)


_DUCK_MONTHLY = f"""
select u.id as user_id, u.plan,
  cast(coalesce(r.requests, 0) as bigint) as requests,
  cast(coalesce(q.queries, 0) as bigint) as queries,
  cast(round(coalesce(s.bytes, 0) / {U.MB}, 2) as double) as storage_mb,
  {_MONTH} as period_start, timestamp '2024-02-01 00:00:00' as period_end
from users u
left join (select user_id, count(*) as requests from usage_logs where created_at >= {_MONTH} group by 1) r
  on r.user_id = u.id
left join (select user_id, count(*) as queries from query_history where created_at >= {_MONTH} group by 1) q
  on q.user_id = u.id
left join (select user_id, sum(file_size) as bytes from datasets group by 1) s on s.user_id = u.id"""


def _monthly(spark, sf_dir):
    return U.monthly_usage(derived(spark, sf_dir, "usage_logs"), derived(spark, sf_dir, "query_history"),
                           derived(spark, sf_dir, "datasets"), derived(spark, sf_dir, "users"), AS_OF)


@register("monthly_usage_users", ["AGG15", "FLT6"],
          duck_with("usage_logs", "query_history", "datasets", "users") + _DUCK_MONTHLY)
def q_monthly(spark, sf_dir):
    return _monthly(spark, sf_dir)


@register("quota_check_users", ["JOIN9", "JOIN4", "AGG15"],
          duck_with("usage_logs", "query_history", "datasets", "users") + f"""
select m.user_id, m.plan, coalesce(p.plan, '{P.DEFAULT_PLAN}') as effective_plan, m.requests, m.queries, m.storage_mb,
  coalesce(p.queries_per_month, {P.PLAN_LIMITS[0][1]}) as queries_limit,
  coalesce(p.storage_mb, {P.PLAN_LIMITS[0][2]}) as storage_limit_mb,
  m.plan = 'enterprise' or m.queries < coalesce(p.queries_per_month, {P.PLAN_LIMITS[0][1]}) as queries_ok,
  m.plan = 'enterprise' or m.storage_mb < coalesce(p.storage_mb, {P.PLAN_LIMITS[0][2]}) as storage_ok
from ({_DUCK_MONTHLY}) m left join {_PLANS} on m.plan = p.plan""")
def q_quota(spark, sf_dir):
    return U.quota_check(_monthly(spark, sf_dir))


@register("active_api_keys", ["FLT8"], duck_with("api_keys") + f"""
select id, user_id, expires_at from api_keys
where is_active and (expires_at is null or timestamp '{AS_OF}' <= expires_at)""")
def q_active_keys(spark, sf_dir):
    return U.active_keys(derived(spark, sf_dir, "api_keys"), AS_OF).select("id", "user_id", "expires_at")


@register("api_keys_with_plan", ["JOIN1"], duck_with("api_keys", "users") + """
select k.id, k.user_id, u.plan from api_keys k join users u on u.id = k.user_id where k.is_active""")
def q_keys_users(spark, sf_dir):
    return U.keys_with_users(derived(spark, sf_dir, "api_keys"), derived(spark, sf_dir, "users")).select(
        "id", "user_id", "plan")


@register("dataset_status_by_space", ["FLT7"], duck_with("datasets") + """
select space_id, cast(count_if(status = 'success') as bigint) as ready_files,
  cast(count_if(status = 'processing') as bigint) as processing_files,
  cast(count_if(status = 'error') as bigint) as error_files from datasets group by space_id""")
def q_status(spark, sf_dir):
    return U.dataset_status(derived(spark, sf_dir, "datasets"))


@register("space_rollup", ["AGG18"], duck_with("datasets") + f"""
select space_id, count(*) as file_count, round(sum(file_size) / {U.MB}, 2) as total_size_mb,
  cast(sum(row_count) as bigint) as total_rows from datasets group by space_id""")
def q_space_rollup(spark, sf_dir):
    return U.space_rollup(derived(spark, sf_dir, "datasets"))


@register("key_storage", ["AGG19"], duck_with("datasets") + f"""
select api_key_id, greatest(0.0, round(sum(file_size) / {U.MB}, 2)) as storage_used_mb, count(*) as datasets
from datasets group by api_key_id""")
def q_key_storage(spark, sf_dir):
    return U.key_storage(derived(spark, sf_dir, "datasets"))


@register("query_log_stats", ["CAT7"], duck_with("query_history") + """
select user_id, cast(created_at as date) as date, count(*) as runs, cast(count_if(status <> 'success') as bigint) as failures,
  cast(sum(row_count) as bigint) as rows, round(avg(execution_time_ms), 2) as avg_ms,
  quantile_cont(execution_time_ms, 0.5) as median_ms
from query_history group by user_id, cast(created_at as date)""")
def q_query_log(spark, sf_dir):
    return U.query_log_stats(derived(spark, sf_dir, "query_history"))


@register("scope_filter_usage", ["FLT3"], duck_with("usage_logs") + """
select id, endpoint, status_code from usage_logs where user_id = 'u7' and api_key_id = 'k7'""")
def q_scope(spark, sf_dir):
    return U.scope_filter(derived(spark, sf_dir, "usage_logs"), user_id="u7", api_key_id="k7").select(
        "id", "endpoint", "status_code")


@register("latency_quantiles_by_key_month", ["CAT7", "DAG6", "DAG5"], duck_with("usage_logs") + """
select api_key_id, cast(date_trunc('month', created_at) as date) as month, count(response_time_ms) as n, true as p50_ok, true as p95_ok, true as p99_ok
from usage_logs where response_time_ms is not null group by 1, 2""")
def q_latency_quantiles(spark, sf_dir):
    """Sketches per key and day, merged to months; each quantile's exact rank error is within the stated bound."""
    from silverline.operators import sketches as SK

    logs = derived(spark, sf_dir, "usage_logs").select("api_key_id", F.to_date("created_at").alias("day"), "response_time_ms")
    daily = materialize(SK.quantile_sketches(logs, ["api_key_id", "day"], "response_time_ms"), "latency-sketches")
    month = F.trunc("day", "month").alias("month")
    wanted = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    found = SK.quantiles(SK.merge_sketches(daily, ["api_key_id", month]), wanted)
    errors = SK.rank_errors(logs.select("api_key_id", month, "response_time_ms"), ["api_key_id", "month"], "response_time_ms", found, wanted)
    return errors.select("api_key_id", "month", "n", *[(F.col(c) <= SK.RANK_ERROR).alias(f"{c}_ok") for c in wanted])

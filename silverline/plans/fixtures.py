"""Tables derived from the driver's Parquet tables, in Spark and as DuckDB twins.

The derivations use only expressions both engines evaluate identically, so
the DuckDB oracle can rebuild the very same inputs from the same Parquet
files.  Each derived table grows with its source table.

``SPARK_SQL[name]`` is Spark SQL over temp views of the base tables;
``DUCK_SQL[name]`` is the DuckDB text of the same table, usable as a CTE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_base(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Temp views of base tables (a DataFrame's plan binds to them when it is built)."""
    for name in names or BASE_TABLES:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)


_NUM = "cast(regexp_extract(source, '([0-9]+)', 1) as int)"

SPARK_SQL = {
    # customers with typed values written as dirty text
    "dirty_customer": """
select c_custkey,
  case when c_custkey % 7 = 0 then null when c_custkey % 11 = 0 then 'n/a'
       else concat('+84', lpad(cast(c_custkey as string), 9, '0')) end as phone,
  case when c_custkey % 13 = 0 then 'bad at mail'
       else concat(lower(replace(c_name, '#', '.')), '@mail.example.com') end as email,
  case when c_custkey % 5 = 0 then null
       else concat(cast(cast(floor(c_acctbal) as bigint) as string), ' đ') end as balance_text,
  concat('  ', c_mktsegment, '   ', cast(c_nationkey as string), ' ') as segment
from customer""",
    # orders with day-first dates, ISO dates, impossible dates and thousands separators
    "dirty_orders": """
select o_orderkey,
  case when o_orderkey % 10 = 0 then '31/02/2024'
       when o_orderkey % 10 = 1 then date_format(o_orderdate, 'yyyy-MM-dd')
       else date_format(o_orderdate, 'dd/MM/yyyy') end as date_text,
  case when o_orderkey % 17 = 0 then 'unknown'
       else concat(cast(cast(floor(o_totalprice / 1000) as bigint) as string), ',',
                   lpad(cast(cast(floor(o_totalprice) % 1000 as bigint) as string), 3, '0')) end as price_text
from orders""",
    # API usage log in the shape of the reference's usage_logs table
    "usage_logs": """
select event_id as id, concat('u', cast(user_id as string)) as user_id,
  concat('k', cast(user_id % 20 as string)) as api_key_id,
  concat('/api/v1/', event_type) as endpoint,
  case when event_type in ('view', 'click') then 'GET' else 'POST' end as method,
  case when event_type = 'error' then 500 else 200 end as status_code,
  cast(floor(value) as int) as response_time_ms,
  cast(floor(value * 100) as bigint) as bytes_transferred,
  ts as created_at
from events""",
    # questions asked in spaces: each user text, whole, after a sentence with a known intent; and the sentence by itself, asked again and again
    "questions": """
select conv_id, turn + 500 * again as turn, concat('s', cast(conv_id % 5 as string)) as space_id,
  concat_ws(' ', element_at(array('Tổng doanh thu là bao nhiêu?', 'Liệt kê danh sách tài liệu',
    'Tìm địa chỉ email của công ty', 'Xin chào', 'max price in account 7', 'list all', cast(null as string)),
    cast(1 + (conv_id * 8 + turn) % 7 as int)), case when again = 0 then text end) as question
from conversations lateral view explode(array(0, 1)) a as again where role = 'user'""",
    # one dataset per document source
    "datasets": f"""
select source as id,
  concat('u', cast({_NUM} % 5 as string)) as user_id,
  concat('s', cast({_NUM} % 4 as string)) as space_id,
  concat('k', cast({_NUM} % 20 as string)) as api_key_id,
  concat(source, '.txt') as name,
  case {_NUM} % 3 when 0 then 'txt' when 1 then 'csv' else 'json' end as file_type,
  cast(sum(n_chars) as bigint) as file_size,
  count(*) as row_count,
  case when {_NUM} % 7 = 3 then 'processing' when {_NUM} % 11 = 5 then 'error' else 'success' end as status,
  cast(date_add(date'2024-01-01', {_NUM}) as timestamp_ntz) as created_at
from documents group by source""",
    "users": """
select distinct concat('u', cast(user_id as string)) as id,
  case when user_id % 13 = 12 then 'legacy'
       else element_at(array('starter', 'pro', 'business', 'enterprise'), cast(1 + user_id % 4 as int)) end as plan,
  user_id % 9 <> 8 as is_active
from events""",
    "api_keys": """
select concat('k', cast(k as string)) as id, concat('u', cast(k as string)) as user_id,
  concat('s', cast(k % 4 as string)) as space_id,
  k % 6 <> 5 as is_active,
  case when k % 4 = 0 then null else cast(date_add(date'2024-01-01', cast(k as int)) as timestamp_ntz) end as expires_at
from (select distinct user_id % 20 as k from events) t""",
    "query_history": """
select event_id as id, concat('u', cast(user_id as string)) as user_id,
  concat('select count(*) from t', cast(user_id % 3 as string)) as query_text,
  case when value < 10 then 'error' else 'success' end as status,
  cast(floor(value * 10) as int) as execution_time_ms,
  cast(floor(value) as bigint) as row_count,
  ts as created_at
from events where event_type = 'purchase'""",
}

DUCK_SQL = {
    "dirty_customer": """
select c_custkey,
  case when c_custkey % 7 = 0 then null when c_custkey % 11 = 0 then 'n/a'
       else concat('+84', lpad(cast(c_custkey as varchar), 9, '0')) end as phone,
  case when c_custkey % 13 = 0 then 'bad at mail'
       else concat(lower(replace(c_name, '#', '.')), '@mail.example.com') end as email,
  case when c_custkey % 5 = 0 then null
       else concat(cast(cast(floor(c_acctbal) as bigint) as varchar), ' đ') end as balance_text,
  concat('  ', c_mktsegment, '   ', cast(c_nationkey as varchar), ' ') as segment
from customer""",
    "dirty_orders": """
select o_orderkey,
  case when o_orderkey % 10 = 0 then '31/02/2024'
       when o_orderkey % 10 = 1 then strftime(o_orderdate, '%Y-%m-%d')
       else strftime(o_orderdate, '%d/%m/%Y') end as date_text,
  case when o_orderkey % 17 = 0 then 'unknown'
       else concat(cast(cast(floor(o_totalprice / 1000) as bigint) as varchar), ',',
                   lpad(cast(cast(floor(o_totalprice) % 1000 as bigint) as varchar), 3, '0')) end as price_text
from orders""",
    "usage_logs": """
select event_id as id, concat('u', cast(user_id as varchar)) as user_id,
  concat('k', cast(user_id % 20 as varchar)) as api_key_id,
  concat('/api/v1/', event_type) as endpoint,
  case when event_type in ('view', 'click') then 'GET' else 'POST' end as method,
  case when event_type = 'error' then 500 else 200 end as status_code,
  cast(floor(value) as int) as response_time_ms,
  cast(floor(value * 100) as bigint) as bytes_transferred,
  ts as created_at
from events""",
    "questions": """
select conv_id, turn + 500 * again as turn, concat('s', cast(conv_id % 5 as varchar)) as space_id,
  concat_ws(' ', (['Tổng doanh thu là bao nhiêu?', 'Liệt kê danh sách tài liệu',
    'Tìm địa chỉ email của công ty', 'Xin chào', 'max price in account 7', 'list all', null])
    [cast(1 + (conv_id * 8 + turn) % 7 as int)], case when again = 0 then text end) as question
from conversations cross join (values (0), (1)) as a(again) where role = 'user'""",
    "datasets": f"""
select source as id,
  concat('u', cast({_NUM} % 5 as varchar)) as user_id,
  concat('s', cast({_NUM} % 4 as varchar)) as space_id,
  concat('k', cast({_NUM} % 20 as varchar)) as api_key_id,
  concat(source, '.txt') as name,
  case {_NUM} % 3 when 0 then 'txt' when 1 then 'csv' else 'json' end as file_type,
  cast(sum(n_chars) as bigint) as file_size,
  count(*) as row_count,
  case when {_NUM} % 7 = 3 then 'processing' when {_NUM} % 11 = 5 then 'error' else 'success' end as status,
  cast(date'2024-01-01' + {_NUM} as timestamp) as created_at
from documents group by source""",
    "users": """
select distinct concat('u', cast(user_id as varchar)) as id,
  case when user_id % 13 = 12 then 'legacy'
       else (['starter', 'pro', 'business', 'enterprise'])[cast(1 + user_id % 4 as int)] end as plan,
  user_id % 9 <> 8 as is_active
from events""",
    "api_keys": """
select concat('k', cast(k as varchar)) as id, concat('u', cast(k as varchar)) as user_id,
  concat('s', cast(k % 4 as varchar)) as space_id,
  k % 6 <> 5 as is_active,
  case when k % 4 = 0 then null else cast(date'2024-01-01' + cast(k as int) as timestamp) end as expires_at
from (select distinct user_id % 20 as k from events) t""",
    "query_history": """
select event_id as id, concat('u', cast(user_id as varchar)) as user_id,
  concat('select count(*) from t', cast(user_id % 3 as varchar)) as query_text,
  case when value < 10 then 'error' else 'success' end as status,
  cast(floor(value * 10) as int) as execution_time_ms,
  cast(floor(value) as bigint) as row_count,
  ts as created_at
from events where event_type = 'purchase'""",
}


DEPENDS = {
    "dirty_customer": "customer", "dirty_orders": "orders", "usage_logs": "events", "questions": "conversations",
    "datasets": "documents", "users": "events", "api_keys": "events", "query_history": "events",
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame (base views are registered from ``sf_dir``)."""
    register_base(spark, sf_dir, [DEPENDS[name]])
    return spark.sql(SPARK_SQL[name])


def duck_with(*names: str) -> str:
    """``WITH`` clause defining the named derived tables for a DuckDB oracle query."""
    return "with " + ",\n".join(f"{n} as ({DUCK_SQL[n]})" for n in names) + "\n"

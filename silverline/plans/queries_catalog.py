"""Catalog and gold-layer queries over datasets derived from documents and dirty customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from silverline.functions import patterns as P
from silverline.operators import catalog as C
from silverline.plans import duck as D
from silverline.plans.fixtures import derived, duck_with, read_table
from silverline.plans.registry import register

DOC_COLUMNS = [("doc_id", "bigint", "integer"), ("text", "string", None), ("lang", "string", None),
               ("n_chars", "bigint", "integer")]
CUSTOMER_COLUMNS = [("c_custkey", "bigint", "integer"), ("phone", "string", None), ("email", "string", None),
                    ("balance_text", "string", None), ("segment", "string", None)]


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("source", "doc_id", "text", "lang", "n_chars")


def _gold_docs(spark, sf_dir):
    return C.promote_all(_docs(spark, sf_dir), "source")


_DUCK_DOC_STATS = D.column_stats_sql("documents", DOC_COLUMNS, ["source"])


def _duck_gold_tables(stats: str, key: str) -> str:
    return f"""
select {key} as dataset_id, cast(max(total_rows) as bigint) as row_count, count(*) as column_count,
  round(avg(valid_percentage), 4) as quality_score, {D.level('avg(valid_percentage)')} as quality_level
from ({stats}) s group by {key}"""


def _duck_gold_columns(stats: str, key: str) -> str:
    return f"""
select {key} as dataset_id, ordinal, column_name, expected_type as column_type,
  case expected_type {' '.join(f"when '{a}' then '{b}'" for a, b in P.SEMANTIC_SQL_TYPES)} else 'VARCHAR' end
    as sql_type,
  null_count > 0 as is_nullable, false as is_primary_key, round(valid_percentage, 4) as valid_percentage
from ({stats}) s"""


def _round_tables(t):
    return t.withColumn("quality_score", F.round("quality_score", 4))


@register("gold_tables_documents", ["CAT3", "CAT5", "PRJ4"], _duck_gold_tables(_DUCK_DOC_STATS, "source"))
def q_gold_tables_docs(spark, sf_dir):
    tables, _ = _gold_docs(spark, sf_dir)
    return _round_tables(tables)


@register("gold_columns_documents", ["CAT4", "TYP10"], _duck_gold_columns(_DUCK_DOC_STATS, "source"))
def q_gold_columns_docs(spark, sf_dir):
    _, cols = _gold_docs(spark, sf_dir)
    return cols.withColumn("valid_percentage", F.round("valid_percentage", 4))


_PARTS_SPARK = "concat('part', cast(c_custkey % 4 as string))"
_DUCK_CUST_STATS = D.column_stats_sql(
    "(select concat('part', cast(c_custkey % 4 as varchar)) as part, * from dirty_customer) dc",
    CUSTOMER_COLUMNS, ["part"])


@register("gold_tables_dirty_customer_parts", ["CAT3", "AGG4", "AGG2"],
          duck_with("dirty_customer") + _duck_gold_tables(_DUCK_CUST_STATS, "part"))
def q_gold_tables_customer(spark, sf_dir):
    dc = derived(spark, sf_dir, "dirty_customer").withColumn("part", F.expr(_PARTS_SPARK))
    tables, _ = C.promote_all(dc, "part")
    return _round_tables(tables)


_DUCK_PART_CELLS = "\n  union all ".join(
    f"select concat('part', cast(c_custkey % 4 as varchar)) as part, '{name}' as column_name, {name} as value from dirty_customer"
    for name, _, semantic in CUSTOMER_COLUMNS if semantic is None)


@register("gold_columns_dirty_customer_parts", ["CAT4", "AGG3"], duck_with("dirty_customer").rstrip() + f""",
profile as ({_DUCK_CUST_STATS}),
cells as ({_DUCK_PART_CELLS}),
bad as (select distinct c.part, c.column_name, c.value from cells c
  join profile t on t.part = c.part and t.column_name = c.column_name
  where c.value is not null and not ({D.valid_for_type('c.value')})),
ranked as (select *, row_number() over (partition by part, column_name order by value) as rank from bad),
samples as (select part as dataset_id, column_name, cast(to_json(list(value order by value)) as varchar) as sample_values
  from ranked where rank <= 3 group by part, column_name)
select g.*, coalesce(s.sample_values, '[]') as sample_values
from ({_duck_gold_columns("select * from profile", "part")}) g
left join samples s on s.dataset_id = g.dataset_id and s.column_name = g.column_name""")
def q_gold_columns_customer(spark, sf_dir):
    dc = derived(spark, sf_dir, "dirty_customer").withColumn("part", F.expr(_PARTS_SPARK))
    _, columns = C.promote_all(dc, "part", samples=3)
    return columns.withColumn("valid_percentage", F.round("valid_percentage", 4))


def _gold_with_space(spark, sf_dir):
    tables, cols = _gold_docs(spark, sf_dir)
    ds = derived(spark, sf_dir, "datasets").select(F.col("id").alias("dataset_id"), "space_id",
                                                   F.col("name").alias("table_name"), "status")
    # only successfully ingested datasets were promoted
    gt = tables.join(ds, "dataset_id").where(F.col("status") == "success").drop("status")
    return gt, cols


_DUCK_GOLD_SPACE = f"""
select g.*, d.space_id, d.name as table_name from ({_duck_gold_tables(_DUCK_DOC_STATS, "source")}) g
join datasets d on d.id = g.dataset_id where d.status = 'success'"""


@register("promotion_summary_by_space", ["AGG12"], duck_with("datasets") + f"""
select space_id, round(avg(quality_score), 2) as average_score, {D.level('avg(quality_score)')} as quality_level,
  count(*) as total_tables, cast(sum(row_count) as bigint) as total_rows from ({_DUCK_GOLD_SPACE}) t group by space_id""")
def q_promotion_summary(spark, sf_dir):
    gt, _ = _gold_with_space(spark, sf_dir)
    return C.promotion_summary(gt.withColumn("quality_score", F.round("quality_score", 4)))


@register("gold_listing_by_space", ["AGG20"], duck_with("datasets") + f"""
select space_id, count(*) as tables, cast(sum(row_count) as bigint) as rows, round(avg(quality_score), 2) as avg_quality
from ({_DUCK_GOLD_SPACE}) t group by space_id""")
def q_gold_listing(spark, sf_dir):
    gt, _ = _gold_with_space(spark, sf_dir)
    return C.gold_listing(gt.withColumn("quality_score", F.round("quality_score", 4)))


@register("gold_tables_with_columns", ["JOIN3"], duck_with("datasets") + f"""
select g.dataset_id, g.table_name, c.column_name, c.sql_type from ({_DUCK_GOLD_SPACE}) g
join ({_duck_gold_columns(_DUCK_DOC_STATS, "source")}) c on c.dataset_id = g.dataset_id""")
def q_tables_columns(spark, sf_dir):
    gt, cols = _gold_with_space(spark, sf_dir)
    return C.tables_with_columns(gt, cols).select("dataset_id", "table_name", "column_name", "sql_type")


@register("schema_context_gold", ["CTX3"], duck_with("datasets") + f"""
select g.dataset_id, g.space_id, concat('Table: ', g.table_name, chr(10),
  string_agg(printf('  %s: %s', c.column_name, c.sql_type), chr(10) order by c.ordinal)) as schema_context
from ({_DUCK_GOLD_SPACE}) g join ({_duck_gold_columns(_DUCK_DOC_STATS, "source")}) c on c.dataset_id = g.dataset_id
group by g.dataset_id, g.space_id, g.table_name""")
def q_schema_context(spark, sf_dir):
    gt, cols = _gold_with_space(spark, sf_dir)
    return C.schema_context(gt, cols)


@register("datasets_not_promoted", ["JOIN6"], duck_with("datasets") + f"""
select id, status from datasets where id not in (select dataset_id from ({_DUCK_GOLD_SPACE}) g)""")
def q_not_promoted(spark, sf_dir):
    gt, _ = _gold_with_space(spark, sf_dir)
    return C.not_promoted(derived(spark, sf_dir, "datasets"), gt).select("id", "status")


@register("newest_datasets_per_space", ["WIN3", "SRT1"], duck_with("datasets") + """
select space_id, id, created_at from datasets
qualify row_number() over (partition by space_id order by created_at desc, id) <= 2""")
def q_newest(spark, sf_dir):
    ds = derived(spark, sf_dir, "datasets")
    return C.newest_per_group(ds, "space_id", [F.col("created_at").desc(), F.col("id")], 2).select(
        "space_id", "id", "created_at")


@register("query_history_newest_per_user", ["LIM3"], duck_with("query_history") + """
select user_id, id, created_at from query_history
qualify row_number() over (partition by user_id order by created_at desc, id) <= 50""")
def q_history_newest(spark, sf_dir):
    h = derived(spark, sf_dir, "query_history")
    return C.newest_per_group(h, "user_id", [F.col("created_at").desc(), F.col("id")], 50).select(
        "user_id", "id", "created_at")


@register("latest_cache_entry", ["WIN4", "TXT10"], duck_with("questions") + """
select space_id, md5(lower(question)) as query_hash, conv_id, turn from questions
qualify row_number() over (partition by space_id, md5(lower(question)) order by conv_id desc, turn desc) = 1""")
def q_latest_cache(spark, sf_dir):
    from silverline.functions.text import question_hash

    qs = derived(spark, sf_dir, "questions").withColumn("query_hash", question_hash("question"))
    w = C.newest_per_group(qs, ["space_id", "query_hash"], [F.col("conv_id").desc(), F.col("turn").desc()], 1)
    return w.select("space_id", "query_hash", "conv_id", "turn")


@register("dataset_preview", ["LIM1"], f"""
with p as (select source as _dataset_id, doc_id, lang, n_chars,
  row_number() over (partition by source order by doc_id) as _row_number from documents)
select _dataset_id, _row_number, doc_id, lang, n_chars, (select count(*) from documents) as total_rows
from p order by _dataset_id, _row_number limit 10""")
def q_preview(spark, sf_dir):
    from silverline.plans.queries_docs import provenance_docs

    p = provenance_docs(spark, sf_dir).select("_dataset_id", "_row_number", "doc_id", "lang", "n_chars")
    return C.preview(p, ["_dataset_id", "_row_number"], 10)


@register("dataset_upsert", ["JOIN7"], duck_with("datasets") + """
select id, status, row_count, updated_at from (
  select id, status, row_count, updated_at, row_number() over (partition by id order by updated_at desc) as rn from (
    select id, status, row_count, created_at as updated_at from datasets
    union all
    select id, 'success', row_count, created_at + interval 1 day from datasets where status = 'processing')
  ) t where rn = 1""")
def q_upsert(spark, sf_dir):
    ds = derived(spark, sf_dir, "datasets").select("id", "status", "row_count", F.col("created_at").alias("updated_at"))
    updates = ds.where(F.col("status") == "processing").select(
        "id", F.lit("success").alias("status"), "row_count",
        (F.col("updated_at") + F.expr("interval 1 day")).alias("updated_at"))
    return C.upsert(ds, updates, "id", "updated_at")


@register("cascade_delete_space", ["JOIN8"], duck_with("datasets") + f"""
select 'datasets' as tbl, count(*) as remaining from datasets where space_id <> 's1'
union all
select 'gold_tables', count(*) from ({_DUCK_GOLD_SPACE}) g where g.dataset_id not in
  (select id from datasets where space_id = 's1')""")
def q_cascade(spark, sf_dir):
    ds = derived(spark, sf_dir, "datasets")
    gt, _ = _gold_with_space(spark, sf_dir)
    deleted = ds.where(F.col("space_id") == "s1")
    remaining_ds, _unused = C.cascade_delete(ds, ds, deleted.select("id"), "id", "id")
    _p, remaining_gt = C.cascade_delete(ds, gt, deleted.select("id"), "id", "dataset_id")
    return remaining_ds.agg(F.count(F.lit(1)).alias("remaining")).select(F.lit("datasets").alias("tbl"), "remaining") \
        .unionByName(remaining_gt.agg(F.count(F.lit(1)).alias("remaining")).select(
            F.lit("gold_tables").alias("tbl"), "remaining"))


@register("list_tables", ["CAT9", "PRJ3"], duck_with("datasets") + """
select lower(replace(name, ' ', '_')) as view_name, name as original_name, row_count, file_type, status from datasets""")
def q_list_tables(spark, sf_dir):
    return C.list_tables(derived(spark, sf_dir, "datasets"))

"""Routing and context queries: intents, routes, cache statistics, packed contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from silverline.functions import patterns as P
from silverline.operators import context as CX
from silverline.operators import routing as R
from silverline.plans import duck as D
from silverline.plans.fixtures import derived, duck_with, read_table
from silverline.plans.registry import register


def _duck_score(col: str, pats) -> str:
    terms = " + ".join(f"cast(regexp_matches(lower({col}), {D.q(P.to_re2(P.py_to_portable(p)))}) as int)" for p in pats)
    return f"({terms})"


_DUCK_INTENT = f"""
select *,
  case when n + a + li + lo = 0 then 'general' when a >= greatest(n, li, lo) then 'aggregate'
       when n >= greatest(li, lo) then 'numeric' when li >= lo then 'list' else 'lookup' end as intent,
  round(case when n + a + li + lo = 0 then 0.5
       else least(0.9, 0.5 + 0.1 * (case when a >= greatest(n, li, lo) then a when n >= greatest(li, lo) then n
                                        when li >= lo then li else lo end)) end, 2) as confidence
from (select conv_id, turn, space_id, question,
        {_duck_score('question', P.NUMERIC_INTENT)} as n, {_duck_score('question', P.AGGREGATE_INTENT)} as a,
        {_duck_score('question', P.LIST_INTENT)} as li, {_duck_score('question', P.LOOKUP_INTENT)} as lo
      from questions) s"""


@register("classify_intent_questions", ["RTE1"], duck_with("questions") + f"""
select conv_id, turn, n as score_numeric, a as score_aggregate, li as score_list, lo as score_lookup,
  intent, cast(confidence as double) as confidence from ({_DUCK_INTENT}) t""")
def q_intent(spark, sf_dir):
    q = R.classify_intent(derived(spark, sf_dir, "questions"), "question")
    return q.select("conv_id", "turn", "score_numeric", "score_aggregate", "score_list", "score_lookup", "intent",
                    "confidence")


@register("classify_intent_conversations", ["RTE1"], f"""
select conv_id, turn,
  case when n + a + li + lo = 0 then 'general' when a >= greatest(n, li, lo) then 'aggregate'
       when n >= greatest(li, lo) then 'numeric' when li >= lo then 'list' else 'lookup' end as intent
from (select conv_id, turn, {_duck_score('text', P.NUMERIC_INTENT)} as n, {_duck_score('text', P.AGGREGATE_INTENT)} as a,
        {_duck_score('text', P.LIST_INTENT)} as li, {_duck_score('text', P.LOOKUP_INTENT)} as lo
      from conversations) s""")
def q_intent_conv(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    return R.classify_intent(conv, "text").select("conv_id", "turn", "intent")


def _gold_tables_by_space(spark, sf_dir):
    # spaces that own a successfully ingested (hence promoted) dataset
    return derived(spark, sf_dir, "datasets").where(F.col("status") == "success").select("space_id", "id")


@register("route_questions", ["RTE2"], duck_with("questions", "datasets") + f"""
select i.conv_id, i.turn, i.intent, cast(coalesce(g.n, 0) as bigint) as gold_tables,
  case when coalesce(g.n, 0) > 0 and i.intent in ('numeric', 'aggregate', 'lookup') then 'sql'
       when i.intent = 'list' and contains(lower(i.question), {D.q(P.DOCUMENT_LIST_PHRASE)}) then 'list_documents'
       else 'ai' end as route
from ({_DUCK_INTENT}) i left join (select space_id, count(*) as n from datasets where status = 'success'
  group by space_id) g on g.space_id = i.space_id""")
def q_route(spark, sf_dir):
    r = R.route(derived(spark, sf_dir, "questions"), _gold_tables_by_space(spark, sf_dir))
    return r.select("conv_id", "turn", "intent", "gold_tables", "route")


@register("cache_stats_questions", ["RTE3", "TXT10"], duck_with("questions") + """
select space_id, md5(lower(question)) as query_hash, count(*) as asked, count(*) - 1 as hits,
  min(conv_id * 1000 + turn) as first_ask, max(conv_id * 1000 + turn) as last_ask
from questions group by space_id, md5(lower(question))""")
def q_cache(spark, sf_dir):
    qs = derived(spark, sf_dir, "questions").withColumn("ask_order", F.col("conv_id") * 1000 + F.col("turn"))
    c = R.cache_stats(qs, "question", ["ask_order"])
    return c.select("space_id", "query_hash", "asked", "hits", F.col("first_ask.ask_order").alias("first_ask"),
                    F.col("last_ask.ask_order").alias("last_ask"))


@register("pack_context_by_source", ["CTX1", "TXT12"], f"""
with d as (select source, doc_id, concat('doc_', cast(doc_id as varchar)) as name, text,
             count(*) over (partition by source) as n from documents),
     b as (select source, doc_id, name, n,
             concat('=== ', name, ' ===', chr(10),
                    left(coalesce(text, ''), cast(least({P.CONTEXT_MAX_CHARS}, floor({P.CONTEXT_TOTAL_CHARS} / n)) as int)))
             as block from d)
select source, n as files, string_agg(block, chr(10) || chr(10) order by doc_id) as context,
  string_agg('• ' || name, chr(10) order by doc_id) as file_list
from b group by source, n""")
def q_pack_context(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").withColumn("name", F.concat(F.lit("doc_"), F.col("doc_id")))
    # the budgets of a language model's prompt are this query's feature; the operator's default keeps whole texts
    return CX.pack_context(docs, "source", "name", "text", order_col="doc_id", max_chars=P.CONTEXT_MAX_CHARS,
                           total_chars=P.CONTEXT_TOTAL_CHARS)


@register("pack_context_parts", ["CTX1"], f"""
with d as (select source, doc_id, md5(coalesce(text, '')) as h, concat('doc_', cast(doc_id as varchar)) as name,
             concat(chr(10), chr(10), '=== ', case when doc_id is null then '' else 'doc_' || cast(doc_id as varchar) end, ' ===', chr(10),
                    coalesce(text, '')) as block from documents),
     b as (select *, count(*) over (partition by source) as files, length(block) as n,
             cast(coalesce(sum(length(block)) over (partition by source order by doc_id nulls first, h
               rows between unbounded preceding and 1 preceding), 0) as bigint) - 2 as start from d),
     p as (select source, files, case when doc_id is null then '' else name end as name, start, unnest(range(greatest(start, 0) // {P.CONTEXT_TOTAL_CHARS},
             (start + n - 1) // {P.CONTEXT_TOTAL_CHARS} + 1)) as part, block, n from b),
     c as (select source, files, name, start, part, greatest(part * {P.CONTEXT_TOTAL_CHARS} - start, 0) as lo,
             least((part + 1) * {P.CONTEXT_TOTAL_CHARS} - start, n) as hi, block from p)
select source, files, part + 1 as part, string_agg(substring(block, lo + 1, hi - lo), '' order by start) as context,
  string_agg('• ' || name, chr(10) order by start) as file_list
from c group by source, files, part""")
def q_context_parts(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").withColumn("name", F.concat(F.lit("doc_"), F.col("doc_id")))
    return CX.context_parts(docs, "source", "name", "text", "doc_id", P.CONTEXT_TOTAL_CHARS)


@register("sample_rows_context", ["CTX2", "WIN2"], """
with p as (select source as _dataset_id, doc_id, lang, n_chars,
             row_number() over (partition by source order by doc_id) as _row_number from documents)
select _dataset_id, count(*) as preview_rows,
  '[' || string_agg(json_object('doc_id', doc_id, 'lang', lang, 'n_chars', n_chars)::varchar, ','
                    order by _row_number) || ']' as rows_json
from p where _row_number <= 100 group by _dataset_id""")
def q_sample_rows(spark, sf_dir):
    from silverline.plans.queries_docs import provenance_docs

    p = provenance_docs(spark, sf_dir).select("_dataset_id", "_row_number", "doc_id", "lang", "n_chars")
    return CX.sample_rows_context(p, "_dataset_id", "_row_number", 100)


@register("raw_documents_newest", ["CTX4"], """
select source, doc_id, md5(text) as text_md5, cast(length(text) as integer) as chars,
  (select count(*) from documents d2 where d2.source = d.source) as total_documents
from documents d qualify row_number() over (partition by source order by doc_id desc) <= 3""")
def q_raw_docs(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    r = CX.raw_documents(docs, "source", [F.col("doc_id").desc()], 3, "text")
    return r.select("source", "doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("chars"),
                    "total_documents")

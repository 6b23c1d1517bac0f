"""Schema, type-inference and typed-cleaning queries (PRJ1/2/7/8/9, TYP1/3/4/5-9, AGG3/5/6/11/21, TXT11/16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from silverline.operators.exchange import redistribute
from silverline.functions import patterns as P
from silverline.functions import text as X
from silverline.operators import catalog as C
from silverline.operators import columns as COL
from silverline.operators import integrity as IN
from silverline.operators import profile as PR
from silverline.plans import duck as D
from silverline.plans.clean import coerce_columns
from silverline.plans.fixtures import derived, duck_with, read_table
from silverline.plans.registry import register
from silverline.plans.queries_quality import DIRTY_CUSTOMER_COLUMNS, DIRTY_ORDERS_COLUMNS
from silverline.functions.types import DATE_FORMATS

# ---------------------------------------------------------------------------
# PRJ1 / PRJ2 / PRJ7 / PRJ8 / PRJ9
# ---------------------------------------------------------------------------


@register("normalize_columns_messy", ["PRJ1"], """
select c_custkey as customer_key, c_name as "tên_khách_vn", c_acctbal as balance, c_mktsegment as balance_1,
  c_nationkey as col_4 from customer""")
def q_normalize_columns(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    messy = c.select(F.col("c_custkey").alias(" Customer Key "), F.col("c_name").alias("Tên khách (VN)"),
                     F.col("c_acctbal").alias("Balance"), F.col("c_mktsegment").alias("balance"),
                     F.col("c_nationkey").alias("___"))
    return COL.normalize_columns(messy)


@register("clean_headers_messy", ["PRJ2", "SRC3"], """
select p_partkey as page_no, p_name as _page, p_brand as col_2, p_type as a_b, p_size as a_b_1 from part""")
def q_clean_headers(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    messy = p.select(F.col("p_partkey").alias(" Page No "), F.col("p_name").alias("_page"), F.col("p_brand").alias(""),
                     F.col("p_type").alias("A B"), F.col("p_size").alias("a b"))
    return COL.normalize_columns(messy, strip_underscore=False)


#: Column layout of the provenance documents (documents columns, then the provenance columns).
PROVENANCE_LAYOUT = [("doc_id", "bigint"), ("content", "string"), ("lang", "string"), ("n_chars", "bigint"),
                     ("_dataset_id", "string"), ("_source_file", "string"), ("_source_type", "string"),
                     ("_row_number", "bigint"), ("_content_hash", "string")]


def _duck_schema_json():
    from pyspark.sql import types as T

    kinds = {"bigint": T.LongType(), "string": T.StringType()}
    layout = T.StructType([T.StructField(n, kinds[t]) for n, t in PROVENANCE_LAYOUT])
    text = COL.schema_json(layout)
    return f"select source as _dataset_id, count(*) as row_count, {D.q(text)} as schema_json from documents group by source"


@register("schema_json_provenance", ["PRJ7"], _duck_schema_json())
def q_schema_json(spark, sf_dir):
    from silverline.plans.queries_docs import provenance_docs

    p = provenance_docs(spark, sf_dir)
    # one row per dataset: its published schema next to its row count
    return p.groupBy("_dataset_id").agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "schema_json", F.lit(COL.schema_json(p)))


@register("conform_columns_datasets", ["PRJ8"], duck_with("datasets") + """
select id, file_size, cast(null as varchar) as description, cast(null as varchar) as storage_url,
  cast(0 as bigint) as row_count_hint from datasets""")
def q_conform(spark, sf_dir):
    ds = derived(spark, sf_dir, "datasets").select("id", "file_size")
    return COL.conform_columns(ds, [("description", "string", None), ("storage_url", "string", None),
                                    ("row_count_hint", "bigint", 0), ("file_size", "bigint", 0)])


@register("map_to_schema_orders", ["PRJ9"], duck_with("dirty_orders") + """
select target, source, type, non_null, converted,
  round(case when non_null > 0 then converted * 100.0 / non_null else 0.0 end, 4) as convert_pct from (
  select 'order_id' as target, 'o_orderkey' as source, 'bigint' as type, count(o_orderkey) as non_null,
    count(try_cast(o_orderkey as bigint)) as converted from dirty_orders
  union all select 'order_date', 'date_text', 'date', count(date_text), count(try_cast(date_text as date)) from dirty_orders
  union all select 'price', 'price_text', 'double', count(price_text), count(try_cast(price_text as double))
    from dirty_orders) t""")
def q_map_schema(spark, sf_dir):
    _, report = COL.map_to_schema(derived(spark, sf_dir, "dirty_orders"), {
        "order_id": ("o_orderkey", "bigint"), "order_date": ("date_text", "date"), "price": ("price_text", "double")})
    return report.withColumn("convert_pct", F.round("convert_pct", 4))


# ---------------------------------------------------------------------------
# TYP1 / TYP3 / TYP4 / TYP5-9
# ---------------------------------------------------------------------------


def _duck_detect(table: str, columns) -> str:
    parts = []
    for i, (name, typ, sem) in enumerate(columns):
        if sem is None:
            dn = D.rx(f"replace(replace({name}, ',', ''), ' ', '')", P.DETECT_NUMERIC)
            d1 = D.rx(name, P.DETECT_DATES[0])
            d2 = D.rx(name, P.DETECT_DATES[1])
        else:
            dn = D.rx(f"replace(cast({name} as varchar), ',', '')", P.DETECT_NUMERIC)
            d1 = d2 = "false"
        parts.append(f"""
select '{table}' as table_name, {i} as ordinal, '{name}' as column_name,
  case when count({name}) = 0 then 'unknown' when count_if({dn}) > count({name}) * {P.INFER_SHARE} then 'numeric'
       when count_if({d1}) > count({name}) * {P.INFER_SHARE} or count_if({d2}) > count({name}) * {P.INFER_SHARE}
       then 'date' else 'text' end as detected_type from {table}""")
    return "\nunion all\n".join(parts)


@register("detect_column_types", ["TYP1"], duck_with("dirty_customer", "dirty_orders")
          + _duck_detect("dirty_customer", DIRTY_CUSTOMER_COLUMNS) + "\nunion all\n"
          + _duck_detect("dirty_orders", DIRTY_ORDERS_COLUMNS))
def q_detect(spark, sf_dir):
    a = PR.detect_column_types(derived(spark, sf_dir, "dirty_customer")).withColumn("table_name", F.lit("dirty_customer"))
    b = PR.detect_column_types(derived(spark, sf_dir, "dirty_orders")).withColumn("table_name", F.lit("dirty_orders"))
    return a.unionByName(b).select("table_name", "ordinal", "column_name", "detected_type")


def _duck_clean_date(s: str) -> str:
    fmts = {"d/M/yyyy": "%d/%m/%Y", "d-M-yyyy": "%d-%m-%Y", "d/M/yy": "%d/%m/%y", "d-M-yy": "%d-%m-%y",
            "yyyy-M-d": "%Y-%m-%d", "yyyy/M/d": "%Y/%m/%d"}
    st = D.strip(s)
    return "coalesce(" + ", ".join(
        f"case when {D.rx(st, shape)} then try_strptime({st}, '{fmts[f]}') end" for shape, f in DATE_FORMATS) + ")"


def _duck_numeric_text(s: str, units) -> str:
    return D.plain_number(D.drop(s, *units))


@register("coerce_columns_dirty_orders", ["TYP3", "TYP7", "TYP5"], duck_with("dirty_orders") + f"""
select o_orderkey, {_duck_clean_date('date_text')} as date_text,
  {_duck_numeric_text('price_text', (',', ' ', 'đ', 'VND'))} as price_text from dirty_orders""")
def q_coerce(spark, sf_dir):
    out, _report = coerce_columns(redistribute(derived(spark, sf_dir, "dirty_orders"), "o_orderkey"), variant="cleaner")
    return out


def _duck_rate_report(table: str, columns, variant: str) -> str:
    units = (",", " ", "đ", "VND") if variant == "cleaner" else (",", " ", "đ", "$")
    parts = []
    for name, typ, sem in columns:
        if sem is not None:
            continue
        num = f"count_if({_duck_numeric_text(name, units)} is not null) / count(*)"
        dat = f"count_if({_duck_clean_date(name)} is not null) / count(*)"
        if variant == "cleaner":
            dn = D.rx(f"replace(replace({name}, ',', ''), ' ', '')", P.DETECT_NUMERIC)
            d1, d2 = D.rx(name, P.DETECT_DATES[0]), D.rx(name, P.DETECT_DATES[1])
            detected = (f"case when count({name}) = 0 then 'unknown' when count_if({dn}) > count({name}) * "
                        f"{P.INFER_SHARE} then 'numeric' when count_if({d1}) > count({name}) * {P.INFER_SHARE} or "
                        f"count_if({d2}) > count({name}) * {P.INFER_SHARE} then 'date' else 'text' end")
            to = (f"case when ({detected}) = 'numeric' and {num} > {P.COERCE_SHARE} then 'numeric' "
                  f"when ({detected}) = 'date' and {dat} > {P.COERCE_SHARE} then 'datetime' end")
            rate = f"case when ({detected}) = 'numeric' then {num} else {dat} end"
        else:
            to = f"case when {num} > {P.COERCE_SHARE} then 'numeric' when {dat} > {P.COERCE_SHARE} then 'datetime' end"
            rate = f"case when {num} > {P.COERCE_SHARE} then {num} else {dat} end"
        parts.append(f"select '{table}' as table_name, '{name}' as column, {to} as to_type, "
                     f"round({rate} * 100, 2) as success_rate from {table}")
    return "select * from (" + "\nunion all\n".join(parts) + ") t where to_type is not null"


@register("coercion_report", ["TYP3", "TYP4"], duck_with("dirty_customer", "dirty_orders") + f"""
select 'cleaner' as variant, * from ({_duck_rate_report('dirty_orders', DIRTY_ORDERS_COLUMNS, 'cleaner')}) a
union all select 'cleaner', * from ({_duck_rate_report('dirty_customer', DIRTY_CUSTOMER_COLUMNS, 'cleaner')}) b
union all select 'extractor', * from ({_duck_rate_report('dirty_orders', DIRTY_ORDERS_COLUMNS, 'extractor')}) c
union all select 'extractor', * from ({_duck_rate_report('dirty_customer', DIRTY_CUSTOMER_COLUMNS, 'extractor')}) d""")
def q_coercion_report(spark, sf_dir):
    out = None
    for variant in ["cleaner", "extractor"]:
        for table in ["dirty_orders", "dirty_customer"]:
            _, rep = coerce_columns(derived(spark, sf_dir, table), variant=variant)
            rep = rep.select(F.lit(variant).alias("variant"), F.lit(table).alias("table_name"), "column",
                             F.col("to_type"), "success_rate")
            out = rep if out is None else out.unionByName(rep)
    return out


_DUCK_MONEY = D.plain_number(D.strip(D.drop("balance_text", ",", ".", "đ", "VND", "đồng", " ")))


@register("typed_cleaning_dirty_customer", ["TYP9", "TYP8", "TXT15", "CAT5"], duck_with("dirty_customer") + f"""
select c_custkey, translate(phone, ' -.', '') as phone, email, {_DUCK_MONEY} as balance_text, segment
from dirty_customer""")
def q_typed_customer(spark, sf_dir):
    gold, _, _ = C.promote(derived(spark, sf_dir, "dirty_customer"), "dirty_customer")
    return gold


@register("typed_cleaning_dirty_orders", ["TYP9", "TYP5", "TYP6", "TYP7"], duck_with("dirty_orders") + f"""
select o_orderkey, {_duck_clean_date('date_text')} as date_text,
  {_duck_numeric_text('price_text', (',', ' ', 'đ', 'VND', '$'))} as price_text,
  cast(round_even({_duck_numeric_text('price_text', (',', ' ', 'đ', 'VND', '$'))} / 1000, 0) as bigint)
    as price_thousands
from dirty_orders""")
def q_typed_orders(spark, sf_dir):
    from silverline.functions.types import clean_integer

    gold, _, _ = C.promote(derived(spark, sf_dir, "dirty_orders"), "dirty_orders")
    raw = derived(spark, sf_dir, "dirty_orders")
    thousands = raw.select("o_orderkey", clean_integer(
        F.concat(F.replace("price_text", F.lit(","), F.lit("")), F.lit("e-3"))).alias("price_thousands"))
    return gold.join(thousands, "o_orderkey")


# ---------------------------------------------------------------------------
# AGG3 / AGG5 / AGG6 / AGG11 / AGG21
# ---------------------------------------------------------------------------

_CUST_STATS = D.column_stats_sql("dirty_customer", DIRTY_CUSTOMER_COLUMNS)


@register("invalid_samples_dirty_customer", ["AGG3"], duck_with("dirty_customer").rstrip() + f""",
cells as (
  select c_custkey, 'phone' as column_name, phone as value from dirty_customer
  union all select c_custkey, 'email', email from dirty_customer
  union all select c_custkey, 'balance_text', balance_text from dirty_customer
  union all select c_custkey, 'segment', segment from dirty_customer),
types as (select column_name, expected_type from ({_CUST_STATS}) s)
select column_name, cast(rank as int) as rank, value from (
  select c.column_name, c.value, row_number() over (partition by c.column_name order by c.c_custkey) as rank
  from cells c join types t on t.column_name = c.column_name
  where c.value is not null and not ({D.valid_for_type('c.value')})) x where rank <= 5""")
def q_invalid_samples(spark, sf_dir):
    dc = derived(spark, sf_dir, "dirty_customer")
    return PR.invalid_samples(dc, PR.validate_columns(dc), ["c_custkey"], 5).withColumn("rank", F.col("rank").cast("int"))


@register("recommendations_dirty_customer", ["AGG5"], duck_with("dirty_customer").rstrip() + f""",
v as ({_CUST_STATS}), q as (select avg(valid_percentage) as score from v)
select 0 as seq, -1 as ordinal, {D.q(P.MESSAGES['rec_below_80'])} as text
  from q where score < {P.REC_LOW_SCORE}
union all
select 1, ordinal, printf({D.q(P.MESSAGES['rec_fill_nulls'])}, column_name) from v
  where null_count > total_rows * {P.REC_NULL_SHARE}
union all
select 1, ordinal, printf({D.q(P.MESSAGES['rec_needs_cleaning'])}, column_name, invalid_count) from v
  where invalid_count > {P.REC_INVALID_COUNT}
union all
select 2, -1, case when score >= {P.GOLD_MIN_SCORE} then {D.q(P.MESSAGES['rec_excellent'])}
                   when score >= {P.REC_GOOD_SCORE} then {D.q(P.MESSAGES['rec_good'])} end from q
  where score >= {P.REC_GOOD_SCORE}""")
def q_recommendations(spark, sf_dir):
    dc = derived(spark, sf_dir, "dirty_customer")
    v = PR.validate_columns(dc)
    return PR.recommendations(v, PR.table_quality(v))


@register("completeness_dirty_customer", ["AGG21", "AGG6"], duck_with("dirty_customer") + """
select cast(count(c_custkey) + count(phone) + count(email) + count(balance_text) + count(segment) as bigint)
    as non_null_cells, cast(count(*) * 5 as bigint) as cells,
  round((count(c_custkey) + count(phone) + count(email) + count(balance_text) + count(segment)) * 100.0
    / (count(*) * 5), 4) as completeness_pct,
  ((count(*) - count(c_custkey)) / count(*) + (count(*) - count(phone)) / count(*) + (count(*) - count(email)) / count(*)
   + (count(*) - count(balance_text)) / count(*) + (count(*) - count(segment)) / count(*)) / 5 > 0.4 as low_quality
from dirty_customer""")
def q_completeness(spark, sf_dir):
    dc = derived(spark, sf_dir, "dirty_customer")
    comp = PR.data_completeness(dc).withColumn("completeness_pct", F.round("completeness_pct", 4))
    low = PR.low_quality_table(dc).select("low_quality")
    return IN._side_by_side(comp, low)


@register("verify_extraction_checks", ["AGG11"], duck_with("dirty_customer") + """
select 'tabular' as kind, true as verified, cast(count(*) as bigint) as extracted_rows, 100.0 as metric from dirty_customer
union all
select 'json', count(*) >= (select count(*) from events) * 0.95, count(*),
  round(least(100.0, count(*) * 100.0 / greatest((select count(*) from events), 1)), 4) from events
  where event_type <> 'error'
union all
select 'text', sum(length(text)) + count(*) - 1 > 100, count(*), cast(sum(length(text)) + count(*) - 1 as double)
from documents""")
def q_verify(spark, sf_dir):
    cust = read_table(spark, sf_dir, "customer")
    dc = derived(spark, sf_dir, "dirty_customer")
    ev = read_table(spark, sf_dir, "events")
    t = IN.verify_extraction(cust, dc, "tabular").select(
        F.lit("tabular").alias("kind"), "verified", "extracted_rows", F.col("accuracy").alias("metric"))
    j = IN.verify_extraction(ev, ev.where(F.col("event_type") != "error"), "json").select(
        F.lit("json").alias("kind"), "verified", "extracted_rows", F.col("accuracy").alias("metric"))
    x = IN.verify_extraction(None, read_table(spark, sf_dir, "documents").select("text"), "text").select(
        F.lit("text").alias("kind"), "verified", "extracted_rows",
        F.col("extracted_characters").cast("double").alias("metric"))
    return t.unionByName(j).unionByName(x).withColumn("metric", F.round("metric", 4))


# ---------------------------------------------------------------------------
# TXT11 / TXT16
# ---------------------------------------------------------------------------


@register("parse_json_block_events", ["TXT11"], """
select event_id, cast(json_extract(props, '$.k') as bigint) as k_fenced,
  cast(json_extract(props, '$.k') as bigint) as k_span, false as error_fenced, true as error_plain
from events""")
def q_parse_json(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    fenced = X.parse_json_block(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
    span = X.parse_json_block(F.concat(F.lit("Answer: "), F.col("props"), F.lit(" - done")))
    plain = X.parse_json_block(F.concat(F.lit("no json here "), F.col("event_type")))
    return ev.select(
        "event_id",
        F.variant_get(fenced["value"], "$.k", "bigint").alias("k_fenced"),
        F.variant_get(span["value"], "$.k", "bigint").alias("k_span"),
        fenced["parse_error"].alias("error_fenced"),
        plain["parse_error"].alias("error_plain"),
    )


@register("decode_bytes_documents", ["TXT16"], """
select doc_id, md5(text) as utf8_md5,
  md5(regexp_replace(text, '[^\\x{00}-\\x{ff}]', '?', 'g')) as latin1_md5 from documents""")
def q_decode(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.md5(X.decode_bytes(F.encode("text", "UTF-8"))).alias("utf8_md5"),
        F.md5(X.decode_bytes(F.encode("text", "ISO-8859-1"))).alias("latin1_md5"),
    )


# ---------------------------------------------------------------------------
# FLT4: every anchored pattern, validator and cleaner variants
# ---------------------------------------------------------------------------

_FLAG_COLS = [("phone", "phone", False), ("email", "email", False), ("balance_text", "money_vn", False),
              ("balance_text", "percentage", False), ("phone", "phone", True), ("balance_text", "money", True),
              ("c_custkey_text", "cccd", True), ("c_custkey_text", "tax_code", True), ("date_text", "date_vn", False)]


def _flag_name(col, kind, cleaner):
    return f"{col}_{'c_' if cleaner else ''}{kind}"


@register("pattern_flags_dirty_customer", ["FLT4"], duck_with("dirty_customer") + "select c_custkey, " + ", ".join(
    f"{D.rx(c, (P.CLEANER_PATTERNS if cl else P.VALIDATOR_PATTERNS)[k])} as {_flag_name(c, k, cl)}"
    for c, k, cl in _FLAG_COLS) + """ from (select *, lpad(cast(c_custkey as varchar), 12, '0') as c_custkey_text,
  concat(cast(c_custkey % 28 + 1 as varchar), '/', cast(c_custkey % 12 + 1 as varchar), '/24') as date_text
  from dirty_customer) t""")
def q_pattern_flags(spark, sf_dir):
    from silverline.functions.types import pattern_is

    dc = derived(spark, sf_dir, "dirty_customer").withColumns({
        "c_custkey_text": F.lpad(F.col("c_custkey").cast("string"), 12, "0"),
        "date_text": F.concat((F.col("c_custkey") % 28 + 1).cast("string"), F.lit("/"),
                              (F.col("c_custkey") % 12 + 1).cast("string"), F.lit("/24")),
    })
    return dc.select("c_custkey", *[F.coalesce(pattern_is(c, k, cl), F.lit(False)).alias(_flag_name(c, k, cl))
                                    for c, k, cl in _FLAG_COLS])

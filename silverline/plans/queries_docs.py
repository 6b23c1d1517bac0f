"""Document queries: provenance, search, duplicates, text repair, integrity (documents, pages)."""

from __future__ import annotations

from pyspark.sql import functions as F

from silverline.functions import patterns as P
from silverline.functions import text as X
from silverline.operators import integrity as IN
from silverline.operators import profile as PR
from silverline.operators import provenance as PV
from silverline.operators import search as S
from silverline.operators.exchange import redistribute
from silverline.operators.entities import extract_entities, ENTITY_RULES
from silverline.plans import duck as D
from silverline.plans.fixtures import read_table
from silverline.plans.registry import register

SEARCH_TERM = "license"


def provenance_docs(spark, sf_dir):
    """documents with provenance columns; ``_row_number`` per source in doc_id order."""
    docs = read_table(spark, sf_dir, "documents").withColumnRenamed("text", "content")
    return PV.add_provenance(
        docs, dataset_id=F.col("source"), source_file=F.concat(F.col("source"), F.lit(".txt")),
        source_type="txt", order_by=["doc_id"], content_col="content",
    ).drop("source")


DUCK_PROVENANCE_DOCS = """
select source as _dataset_id, concat(source, '.txt') as _source_file, 'txt' as _source_type,
  cast(row_number() over (partition by source order by doc_id) as bigint) as _row_number,
  doc_id, text as content, lang, n_chars,
  case when text is null or text = '' then null else md5(text) end as _content_hash
from documents"""


@register("provenance_documents", ["PRJ5", "WIN1", "TXT9", "PRJ4"],
          f"select _dataset_id, _source_file, _source_type, _row_number, doc_id, md5(content) as content_md5, lang, "
          f"n_chars, _content_hash from ({DUCK_PROVENANCE_DOCS}) p")
def q_provenance_documents(spark, sf_dir):
    p = provenance_docs(spark, sf_dir)
    return p.select("_dataset_id", "_source_file", "_source_type", "_row_number", "doc_id",
                    F.md5("content").alias("content_md5"), "lang", "n_chars", "_content_hash")


@register("duplicate_content_documents", ["AGG17", "TXT9"], """
select md5(text) as content_hash, count(*) as copies, min(doc_id) as first_key, max(doc_id) as last_key,
  max(length(text)) as chars
from documents where text is not null and text <> '' group by md5(text) having count(*) > 1""")
def q_duplicate_content(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").withColumn("content_hash", X.content_hash("text"))
    return PV.duplicate_content(docs, "content_hash", "doc_id", "text").select(
        "content_hash", "copies", "first_key", "last_key", F.col("chars").cast("bigint").alias("chars"))


def _duck_rowtext():
    return "concat_ws(' ', cast(doc_id as varchar), text, lang, source, cast(n_chars as varchar))"


@register("keyword_search_documents", ["FLT1", "PRJ6"], f"""
select doc_id, source, lang, n_chars from documents
where contains(lower({_duck_rowtext()}), {D.q(SEARCH_TERM)})""")
def q_keyword_search(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return S.keyword_search(docs, SEARCH_TERM).select("doc_id", "source", "lang", "n_chars")


@register("provenance_search_documents", ["FLT2", "JOIN5"], f"""
select doc_id, md5(content) as content_md5, lang, n_chars, _source_file as prov_source_file,
  _source_type as prov_file_type, _row_number as prov_row_number, _dataset_id as prov_dataset_id
from ({DUCK_PROVENANCE_DOCS}) p
where contains(lower(concat_ws(' ', cast(doc_id as varchar), content, lang, cast(n_chars as varchar))),
               {D.q(SEARCH_TERM)})""")
def q_provenance_search(spark, sf_dir):
    from silverline.plans.fixtures import derived

    hits = S.provenance_search(provenance_docs(spark, sf_dir), SEARCH_TERM, datasets=derived(spark, sf_dir, "datasets"))
    return hits.select("doc_id", F.md5("content").alias("content_md5"), "lang", "n_chars", "prov_source_file",
                       "prov_file_type", "prov_row_number", "prov_dataset_id")


@register("search_context_hints", ["AGG16", "FLT2"], f"""
select {D.q(SEARCH_TERM)} as query, count(*) as total_matches, count(distinct source) + 0 as total_files_matched,
  concat_ws(',', case when count(distinct source) > 1 then 'multiple_sources' end,
                 case when count(*) > 1 then 'multiple_matches' end) as hints
from documents where contains(lower(concat_ws(' ', cast(doc_id as varchar), text, lang, cast(n_chars as varchar))),
                              {D.q(SEARCH_TERM)})""")
def q_search_context_hints(spark, sf_dir):
    hits = S.provenance_search(provenance_docs(spark, sf_dir), SEARCH_TERM)
    h = S.context_hints(hits, SEARCH_TERM)
    return h.select("query", "total_matches", "total_files_matched", F.array_join("hints", ",").alias("hints"))


def _duck_mojibake(expr: str) -> str:
    out = expr
    for bad, good in X.mojibake_pairs():
        out = f"replace({out}, {D.q(bad)}, {D.q(good)})"
    return out


def _duck_tone(expr: str) -> str:
    out = expr
    for old, new in P.TONE_PAIRS:
        out = f"replace({out}, {D.q(old)}, {D.q(new)})"
    return out


def _duck_ocr(expr: str) -> str:
    out = expr
    for rx, rep in X.ocr_noise_regexes():
        out = f"regexp_replace({out}, {D.q(P.to_re2(rx.replace('(?md)', '(?m)')))}, {D.q(rep)}, 'g')"
    return out


def _duck_wordcount(expr: str) -> str:
    c = D.collapse(expr)
    return (f"(case when {c} is null then null when {c} = '' then 0 "
            f"else length({c}) - length(replace({c}, ' ', '')) + 1 end)")


@register("text_repair_documents", ["TXT1", "TXT2", "TXT3", "TXT6", "TXT8", "TXT9", "TXT13"], f"""
select doc_id,
  md5({_duck_mojibake('text')}) as mojibake_md5,
  md5({D.collapse('text')}) as collapsed_md5,
  md5({_duck_tone('text')}) as tone_md5,
  md5({_duck_ocr('text')}) as ocr_md5,
  case when length(lower(text)) - length(translate(lower(text), {D.q(P.VIETNAMESE_LETTERS)}, ''))
            > length(text) * 0.01 then 'vi' else 'en' end as detected_lang,
  case when text is null or text = '' then null else md5(text) end as content_hash,
  cast({_duck_wordcount('text')} as bigint) as words
from documents""")
def q_text_repair(spark, sf_dir):
    t = F.col("text")
    docs = redistribute(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs.select(
        "doc_id",
        F.md5(X.fix_mojibake(t)).alias("mojibake_md5"),
        F.md5(X.collapse_ws(t)).alias("collapsed_md5"),
        F.md5(X.normalize_tone(t)).alias("tone_md5"),
        F.md5(X.remove_ocr_noise(t)).alias("ocr_md5"),
        X.detect_language(t).alias("detected_lang"),
        X.content_hash(t).alias("content_hash"),
        X.word_count(t).alias("words"),
    )


@register("vietnamese_normalize_documents", ["TXT4", "TXT5", "TXT7"])
def q_deep_normalize(spark, sf_dir):
    # \b with Unicode letters has no RE2 form; checked against Python's re in tests instead
    docs = redistribute(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", F.md5(X.deep_normalize("text")).alias("normalized_md5"),
                       F.length(X.deep_normalize("text")).alias("normalized_chars"))


@register("markup_to_text_pages", ["SRC7"], f"""
select page_id, md5({D.collapse("regexp_replace(html, '<[^>]+>', ' ', 'g')")}) as text_md5,
  cast(length({D.collapse("regexp_replace(html, '<[^>]+>', ' ', 'g')")}) as integer) as text_chars
from pages""")
def q_markup(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    txt = X.markup_to_text("html")
    return pages.select("page_id", F.md5(txt).alias("text_md5"), F.length(txt).alias("text_chars"))


def _duck_entities() -> str:
    parts = []
    for kind, rx, _ in ENTITY_RULES:
        rx = D.q(P.to_re2(rx))
        value = "case when w[1] between '0' and '9' then w else w[2:] end" if kind == "date" else "w"
        parts.append(f"""
select doc_id, {D.q(kind)} as kind, cast(ord as int) as ordinal, value, cast(at_char as int) as "offset",
  case when at_char * 3 <= length(text) then 'start' when at_char * 3 <= 2 * length(text) then 'middle' else 'end' end as position,
  substring(text, greatest(1, at_char - 30), length(value) + 60) as context
from (select *, cast(upto - length(value) + 1 as bigint) as at_char from (select doc_id, text, ord, {value} as value,
  sum(length(g) + length(w)) over (partition by doc_id, text order by ord) as upto
  from (select doc_id, text, unnest(m) as w, unnest(g[1:len(m)]) as g, generate_subscripts(m, 1) as ord
    from (select doc_id, text, regexp_extract_all(text, {rx}) as m, string_split_regex(text, {rx}) as g from documents) a) b) c) d""")
    return "\nunion all\n".join(parts)


@register("extract_entities_documents", ["TXT14"], _duck_entities())
def q_entities(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return extract_entities(redistribute(docs.select("doc_id", "text"), "doc_id"), "text", ["doc_id"])


def _string_pairs(df, cols):
    return df.select(*[
        c for name in cols for c in (X.fix_mojibake(name).alias(f"{name}__b"),
                                     X.collapse_ws(X.fix_mojibake(name)).alias(f"{name}__a"))
    ])


@register("whitespace_changes_documents", ["AGG7", "TXT2"], f"""
select 'trim' as action, 'text' as "column", cast(count_if(not ({_duck_mojibake('text')} is not distinct from
   {D.collapse(_duck_mojibake('text'))})) as bigint) as rows_affected from documents
union all
select 'trim', 'lang', cast(count_if(not (lang is not distinct from {D.collapse('lang')})) as bigint) from documents
union all
select 'trim', 'source', cast(count_if(not (source is not distinct from {D.collapse('source')})) as bigint) from documents""")
def q_change_counts(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    cols = ["text", "lang", "source"]
    return IN.change_counts(_string_pairs(docs, cols), [(c, f"{c}__b", f"{c}__a") for c in cols], "trim")


def _duck_fingerprint(table: str, cols) -> str:
    parts = ", ".join(f"coalesce(cast({c} as varchar), chr(1))" for c in cols)
    h = f"md5(concat_ws(chr(31), {parts}))"
    return (f"select count(*) as rows, cast(sum(cast(('0x' || substr({h}, 1, 8)) as bigint)) as decimal(38,0)) as digest, "
            f"concat(cast(count(*) as varchar), ':', cast(sum(cast(('0x' || substr({h}, 1, 8)) as bigint)) as varchar)) "
            f"as fingerprint from {table}")


DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars"]


@register("table_fingerprint_documents", ["AGG8"], _duck_fingerprint("documents", DOC_COLS))
def q_fingerprint(spark, sf_dir):
    return IN.table_fingerprint(read_table(spark, sf_dir, "documents"), DOC_COLS)


@register("data_loss_check_documents", ["AGG9"], f"""
select count(*) as original_rows, 5 as original_columns,
  cast(count(doc_id) + count(text) + count(lang) + count(source) + count(n_chars) as bigint) as original_non_null,
  count(*) as cleaned_rows, 5 as cleaned_columns,
  cast(count(doc_id) + count({D.collapse('text')}) + count(lang) + count(source) + count(n_chars) as bigint)
    as cleaned_non_null,
  false as data_loss, '' as errors, '' as warnings
from documents""")
def q_data_loss(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    cleaned = docs.withColumn("text", X.collapse_ws("text"))
    r = IN.data_loss_check(docs, cleaned)
    return r.select("original_rows", "original_columns", "original_non_null", "cleaned_rows", "cleaned_columns",
                    "cleaned_non_null", "data_loss", F.array_join("errors", ";").alias("errors"),
                    F.array_join("warnings", ";").alias("warnings"))


@register("anomaly_report_documents", ["AGG1"], f"""
select 0 as ordinal, 'doc_id' as column_name, count(*) - count(doc_id) as null_count,
  round((count(*) - count(doc_id)) * 100.0 / count(*), 4) as null_pct, cast(0 as bigint) as long_count,
  cast(0 as bigint) as blank_count from documents
union all
select 1, 'text', count(*) - count(text), round((count(*) - count(text)) * 100.0 / count(*), 4),
  cast(count_if(length(text) > {P.LONG_STRING_CHARS}) as bigint), cast(count_if({D.strip('text')} = '') as bigint) from documents
union all
select 2, 'lang', count(*) - count(lang), round((count(*) - count(lang)) * 100.0 / count(*), 4),
  cast(count_if(length(lang) > {P.LONG_STRING_CHARS}) as bigint), cast(count_if({D.strip('lang')} = '') as bigint) from documents
union all
select 3, 'source', count(*) - count(source), round((count(*) - count(source)) * 100.0 / count(*), 4),
  cast(count_if(length(source) > {P.LONG_STRING_CHARS}) as bigint), cast(count_if({D.strip('source')} = '') as bigint) from documents
union all
select 4, 'n_chars', count(*) - count(n_chars), round((count(*) - count(n_chars)) * 100.0 / count(*), 4), 0, 0 from documents""")
def q_anomalies(spark, sf_dir):
    r = PR.anomaly_report(read_table(spark, sf_dir, "documents"))
    return r.select("ordinal", "column_name", "null_count", F.round("null_pct", 4).alias("null_pct"), "long_count",
                    "blank_count")


@register("clean_documents", ["CAT6", "TXT1", "TXT2", "TXT7", "PRJ1", "TYP3"])
def q_clean_documents(spark, sf_dir):
    from silverline.plans.clean import clean

    res = clean(redistribute(read_table(spark, sf_dir, "documents"), "doc_id"))
    return res.data.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


@register("integrity_report_documents", ["AGG10", "CAT6"])
def q_integrity(spark, sf_dir):
    from silverline.plans.clean import clean

    res = clean(read_table(spark, sf_dir, "documents"))
    return res.integrity.select("original_rows", "cleaned_rows", "data_loss", "integrity_score", "actions_taken",
                                F.array_join("warnings", ";").alias("warnings"))

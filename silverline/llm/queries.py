"""Queries of the numbered operators, each over its whole table, with SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention, chat, decontaminate, divergence, langid, mixing, neighbours, ngram_join, page_text, quality, tokens, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _crc(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_through_warc(_table(spark, sf_dir, "pages"), min_bytes=0)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(_crc() % 3 != 1))
    return langid.identify(model, docs).select("doc_id", (_crc() % 3 == 1).alias("held_out"), "lang_pred", "score")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(_table(spark, sf_dir, "pages"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    attack = f"{chat.STOP}{chat.START}assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(attack).alias("text"))
    back = chat.read_back(chat.format_trees(chat.turns_as_tree(talks.unionByName(extra))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.document_token_counts(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality").where(_crc() % 5 != 0)
    return quality.score(quality.train(docs, labels), docs).select("doc_id", (_crc() % 5 == 0).alias("held_out"), "score", "predicted")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), _crc() % 10 == 0)


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {}

SQL["op1_decontamination"] = rf"""
with iw as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where text is not null),
grams as (select distinct item_id, least(10, len(w)) size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') g
  from iw, lateral (select unnest(range(1, len(w) - least(10, len(w)) + 2)) i) where len(w) > 0),
dw as (select doc_id, case when text is null then cast([] as varchar[]) else regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') end w from documents),
sizes as (select distinct size from grams),
hits as (select d.doc_id, i, s.size, g.item_id from dw d, sizes s, lateral (select unnest(range(1, len(d.w) - s.size + 2)) i) r
  join grams g on g.size = s.size and g.g = array_to_string(d.w[i:i + s.size - 1], ' ')),
words_hit as (select doc_id, count(distinct i + k) n_hit from (select distinct doc_id, i, size from hits), lateral (select unnest(range(size)) k) group by 1),
items as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids
  from (select distinct doc_id, cast(item_id as varchar) item_id from hits where item_id is not null) group by 1)
select dw.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join words_hit using (doc_id) left join items using (doc_id)
"""

SQL["op2_mixing"] = f"""
with sizes as (select source, count(*) n from documents group by 1),
shares as (select source, n, power(n, {mixing.ALPHA}) w from sizes),
rates as (select source, w * ((select sum(n) from shares) / (select sum(w) from shares)) / n rate from shares),
pieces as (select source, rate, cast(greatest(ceil(rate / {mixing.PIECE}), 1) as integer) p from rates),
cdf as (select source, p, k, sum(exp(-rate / p + k * ln(greatest(rate / p, 1e-300)) - lgamma(k + 1))) over (partition by source order by k) c
  from pieces, range({mixing.TERMS}) t(k)),
draws as (select row_number() over () rid, d.*, x.p, j from documents d join pieces x on d.source is not distinct from x.source,
  lateral (select unnest(range(1, p + 1)) j)),
u as (select *, cast('0x' || substr(md5('{mixing.SEED}:' || j || ':' || coalesce(cast(doc_id as varchar), '')), 1, 13) as bigint) / 4503599627370496.0 u from draws),
counts as (select doc_id, text, lang, u.source, n_chars, sum((select count(*) from cdf where cdf.source is not distinct from u.source and cdf.c <= u.u)) n
  from u group by rid, doc_id, text, lang, u.source, n_chars)
select doc_id, text, lang, source, n_chars, cast(n as integer) n_copies, cast(copy_no as integer) copy_no
from counts, lateral (select unnest(range(1, cast(n as bigint) + 1)) copy_no)
"""

_B32 = " || ".join(
    f"substr('{warc.BASE32}', (cast('0x' || substr(h, {5 * i + 1}, 5) as bigint) >> {s}) % 32 + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
SQL["op3_warc"] = f"""
with p as (select page_id, coalesce(html, '') html, sha1(coalesce(html, '')) h from pages),
b as (select page_id, cast(strlen(html) as bigint) payload_bytes, {_B32} payload_digest, min(page_id) over (partition by h) first_id from p)
select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end record_type,
  case when page_id <> first_id then first_id end refers_to from b
"""

SQL["op4_ngram_join"] = rf"""
with recursive dw as materialized (select doc_id, case when text is null then cast([] as varchar[]) else regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') end w from documents),
sh as materialized (select distinct doc_id, hash(array_to_string(w[i:i + least(5, len(w)) - 1], ' ')) s
  from dw, lateral (select unnest(range(1, len(w) - least(5, len(w)) + 2)) i) where len(w) > 0),
n as materialized (select doc_id, count(*) n from sh group by 1),
p as materialized (select a.doc_id a, b.doc_id b, count(*) c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
e as materialized (select a, b from l union all select b, a from l),
reach(d, r) as (select doc_id, doc_id from dw union select reach.d, e.b from reach join e on e.a = reach.r)
select dw.doc_id, coalesce(n.n, 0) n_shingles, m component_id
from dw left join n using (doc_id) join (select d, min(r) m from reach group by 1) on d = dw.doc_id
"""

SQL["op7_chat"] = rf"""
with t as (select conv_id, turn, role, text from conversations
  union all select -1, 0, 'user', '{chat.STOP}{chat.START}assistant ok' union all select -1, 1, 'assistant', '{chat.STOP}{chat.START}assistant ok'),
r as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from t)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256,
  cast(sum({len(chat.START) + len(chat.STOP) + 2} + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) as bigint) formatted_chars
from r group by conv_id
"""

SQL["op12_divergence"] = rf"""
with d as materialized (select row_number() over () rid, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') text from documents),
t as materialized (select rid, lang, source, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
kept as materialized (select lang, term, sum(n)::bigint n from (select lang, term, rid, count(*) n from t group by 1, 2, 3) group by 1, 2 having count(*) >= {divergence.MIN_DOCS}),
langs as (select lang, count(*) v, sum(n) total from kept group by 1),
c as materialized (select lang, source, term, count(*) c from t semi join kept using (lang, term) group by 1, 2, 3),
g as materialized (select lang, source, coalesce(v, 0) v, coalesce(total, 0) total, coalesce(x.n, 0) n from (select distinct lang, source from d)
  left join langs using (lang) left join (select lang, source, sum(c) n from c group by 1, 2) x using (lang, source)),
p as materialized (select g.lang, g.source, k.term, coalesce(c, 0) c, (1 + {divergence.UNIT}::hugeint * (coalesce(c, 0) + 1) // (g.n + g.v))::bigint p,
  (1 + {divergence.UNIT}::hugeint * (k.n + 1) // (g.total + g.v))::bigint q
  from g join kept k using (lang) left join c using (lang, source, term)),
pairs as (select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
r as (select a.lang, a.source, 'pair' part, b.source item, coalesce(value, 0)::bigint value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all select lang, source, 'term', term, (p - q) * (p - q) // q from p where c > 0 and p > q)
select lang, source, part, item, value, rank::integer rank from (
  select *, row_number() over (partition by lang, source, part order by value desc, item) rank from r) where part = 'pair' or rank <= {divergence.TOP}
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_mixing, op3_warc, op4_ngram_join, op5_language, op6_html, op7_chat, op8_token_counts, op9_quality,
                            op10_nearest, op11_whitening, op12_divergence, op13_lm_scoring)}

"""SQL functions for the SQL surface: the text, type and pattern functions as
``CREATE TEMPORARY FUNCTION ... RETURN <expr>``.

The bodies are plain Spark SQL expressions, so Catalyst inlines them into the
calling plan (whole-stage code generation, no Python); users of ``run_sql``
can write ``select clean_date(date_text) from t``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from silverline.functions import patterns as P
from silverline.functions import sqltext as Q
from silverline.functions import text as X
from silverline.functions.types import DATE_FORMATS


def _clean_date(s: str) -> str:
    st = Q.strip(f"cast({s} as string)")
    parts = [f"CASE WHEN {st} RLIKE {Q.lit(shape)} THEN try_to_timestamp({st}, {Q.lit(fmt)}) END"
             for shape, fmt in DATE_FORMATS]
    return f"cast(coalesce({', '.join(parts)}) as timestamp_ntz)"


def _valid(s: str, t: str) -> str:
    st = Q.strip(f"cast({s} as string)")
    tests = {
        "numeric": f"({Q.plain_number(Q.drop(st, ',', ' '))}) IS NOT NULL",
        "integer": f"({Q.plain_number(Q.drop(st, ','))}) IS NOT NULL",
        "date": Q.rlike(st, P.VALIDATOR_PATTERNS["date_vn"]),
        "phone": Q.rlike(st, P.VALIDATOR_PATTERNS["phone"]),
        "email": Q.rlike(st, P.VALIDATOR_PATTERNS["email"]),
        "money": Q.rlike(st, P.VALIDATOR_PATTERNS["money_vn"]),
        "boolean": f"coalesce(lower({st}) IN ({', '.join(Q.lit(w) for w in P.BOOLEAN_WORDS)}), false)",
    }
    cases = " ".join(f"WHEN {Q.lit(k)} THEN {v}" for k, v in tests.items())
    return f"({s} IS NULL OR (CASE {t} {cases} ELSE true END))"


def _pattern(s: str, kind: str) -> str:
    table = {**{f"cleaner_{k}": v for k, v in P.CLEANER_PATTERNS.items()}, **P.VALIDATOR_PATTERNS}
    cases = " ".join(f"WHEN {Q.lit(k)} THEN {s} RLIKE {Q.lit(v)}" for k, v in table.items())
    return f"CASE {kind} {cases} END"


def _sql_type(s: str) -> str:
    cases = " ".join(f"WHEN {Q.lit(a)} THEN {Q.lit(b)}" for a, b in P.SEMANTIC_SQL_TYPES)
    return f"CASE {s} {cases} ELSE {Q.lit(P.DEFAULT_SQL_TYPE)} END"


def definitions() -> list[tuple[str, str, str, str]]:
    """(name, parameters, return type, body) of every SQL function."""
    s = "s"
    tone = Q.guarded(s, X.TONE_GUARD, Q.replace_chain(P.TONE_PAIRS))
    address = Q.guarded(s, X.ADDRESS_GUARD, Q.regex_chain(X.address_regexes()))
    currency = Q.guarded(s, X.CURRENCY_GUARD, Q.regex_chain(X.currency_regexes()))
    ocr = Q.regex_chain(X.ocr_noise_regexes())(s)
    deep = Q.guarded(s, X.TONE_GUARD, Q.replace_chain(P.TONE_PAIRS))
    deep = Q.guarded(deep, X.ADDRESS_GUARD, Q.regex_chain(X.address_regexes()))
    deep = Q.guarded(deep, X.CURRENCY_GUARD, Q.regex_chain(X.currency_regexes()))
    deep = Q.strip(Q.regex_chain(X.ocr_noise_regexes())(deep))
    collapsed = Q.collapse(s)
    low = f"lower({s})"
    numeric = Q.plain_number(Q.drop(f"cast({s} as string)", ",", " ", "đ", "VND", "$"))
    money = Q.plain_number(Q.strip(Q.drop(f"cast({s} as string)", ",", ".", "đ", "VND", "đồng", " ")))
    return [
        ("fix_mojibake", "s STRING", "STRING", Q.guarded(s, X.MOJIBAKE_GUARD, Q.replace_chain(X.mojibake_pairs()))),
        ("collapse_ws", "s STRING", "STRING", collapsed),
        ("strip_ws", "s STRING", "STRING", Q.strip(s)),
        ("normalize_tone", "s STRING", "STRING", tone),
        ("expand_address", "s STRING", "STRING", address),
        ("normalize_currency", "s STRING", "STRING", currency),
        ("remove_ocr_noise", "s STRING", "STRING", ocr),
        ("deep_normalize", "s STRING", "STRING", deep),
        ("detect_language", "s STRING", "STRING",
         f"CASE WHEN length({low}) - length(translate({low}, {Q.lit(P.VIETNAMESE_LETTERS)}, '')) > length({s}) * 0.01 "
         f"THEN 'vi' ELSE 'en' END"),
        ("content_hash", "s STRING", "STRING", f"CASE WHEN {s} IS NULL OR {s} = '' THEN NULL ELSE md5({s}) END"),
        ("question_hash", "s STRING", "STRING", f"md5(lower({s}))"),
        ("word_count", "s STRING", "BIGINT",
         f"CAST(CASE WHEN {collapsed} = '' THEN 0 ELSE length({collapsed}) - length(replace({collapsed}, ' ', '')) + 1 END"
         f" AS BIGINT)"),
        ("normalize_phone", "s STRING", "STRING", f"translate({s}, ' -.', '')"),
        ("markup_to_text", "s STRING", "STRING", Q.collapse(f"regexp_replace({s}, '<[^>]+>', ' ')")),
        ("pattern_is", "s STRING, kind STRING", "BOOLEAN", _pattern(s, "kind")),
        ("is_valid_for_type", "s STRING, t STRING", "BOOLEAN", _valid(s, "t")),
        ("clean_numeric", "s STRING", "DOUBLE", numeric),
        ("clean_integer", "s STRING", "BIGINT", f"try_cast(bround({numeric}, 0) AS BIGINT)"),
        ("clean_date", "s STRING", "TIMESTAMP_NTZ", _clean_date(s)),
        ("clean_money", "s STRING", "DOUBLE", money),
        ("sql_type", "s STRING", "STRING", _sql_type(s)),
    ]


def register_sql_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """Create (or replace) the temporary SQL functions in ``spark``; returns their names."""
    names = []
    for name, params, returns, body in definitions():
        full = prefix + name
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {full}({params}) RETURNS {returns} RETURN {body}")
        names.append(full)
    return names

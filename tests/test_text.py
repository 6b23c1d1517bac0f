"""Text expressions vs a plain-Python model of the same fixed rules (brute force per value)."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from silverline.functions import patterns as P
from silverline.functions import text as X


# --- plain-Python model, built from the same fixed values ------------------

def py_tone(s):
    for a, b in P.TONE_PAIRS:
        s = s.replace(a, b)
    return s


def py_address(s):
    for abbr, dot, exp in P.ADDRESS_ABBREVIATIONS:
        s = re.sub(r"\b" + re.escape(abbr) + (r"\.?" if dot else "") + r"\b", exp, s, flags=re.IGNORECASE)
    return s


def py_currency(s):
    s = re.sub(r"\b(" + "|".join(re.escape(w) for w in P.CURRENCY_WORDS) + r")\b", P.CURRENCY_CANONICAL, s,
               flags=re.IGNORECASE)
    return re.sub(r"([\d\.,]+)\s*" + P.CURRENCY_CANONICAL, r"\1 " + P.CURRENCY_CANONICAL, s)


def py_ocr(s):
    s = re.sub(r",{2,}", ",", s)
    s = re.sub(r"\.{4,}", "...", s)
    s = re.sub(r"^[|I1]\s+", "", s, flags=re.MULTILINE)
    return re.sub(r"\s+[|I1]$", "", s, flags=re.MULTILINE)


def py_deep(s):
    return py_ocr(py_currency(py_address(py_tone(s)))).strip()


def py_collapse(s):
    return " ".join(s.split())


EDGE = [
    "hòa thủy", "TP. HCM", "TP.HCM", "Q.1 P.5", "100đ", "5 đ", "10,000 VND", "a,,,b", ".....", "| dòng 1", "I x",
    "12.50 đ", "Khu CN Tân Bình", "KCN VSIP", "SĐT 0912", "ĐT: 028", "h. Củ Chi", "x. Bình", "Đ. Lê Lợi",
    "giá 1.000.000 vnđ", "3 đồng", "vn đ", "tab\there", "  lead and trail  ", "", "line1 1\nI line2\n| x",
    "Ông Quản lý P", "Xã tp", "ĐTHCM", "đường", "TPHCM", "Số 5, Q. Bình Thạnh, TP.HCM",
]


def _apply(spark, fn, values):
    """Apply through both paths (Column expression and SQL text for a named column); they must agree."""
    df = spark.createDataFrame([(v,) for v in values], "s string")
    rows = df.select(fn(F.col("s")).alias("a"), fn("s").alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows], fn.__name__
    return [r.a for r in rows]


def test_deep_normalize_matches_python_model(spark):
    got = _apply(spark, X.deep_normalize, EDGE)
    assert got == [py_deep(v) for v in EDGE]


def test_steps_match_python_model(spark):
    for fn, model in [(X.normalize_tone, py_tone), (X.expand_address, py_address),
                      (X.normalize_currency, py_currency), (X.remove_ocr_noise, py_ocr), (X.collapse_ws, py_collapse)]:
        assert _apply(spark, fn, EDGE) == [model(v) for v in EDGE], fn.__name__


ALPHABET = st.sampled_from(list("abcTPHQXđĐdqhpx .,|I1\n\t òaủyVNDđồng0123456789-:/") + ["TP.", "KCN", "Khu CN", "SĐT"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=25).map("".join), min_size=1, max_size=20))
def test_random_strings_match_python_model(spark, values):
    assert _apply(spark, X.deep_normalize, values) == [py_deep(v) for v in values]
    assert _apply(spark, X.collapse_ws, values) == [py_collapse(v) for v in values]


def test_mojibake_roundtrip_and_clean_text_unchanged(spark):
    clean = "Tiếng Việt có dấu: Đường Lê Lợi, Quận Ba Đình, hoà thuỷ, ăn ở, ngưỡng cửa"
    garbled = "".join(X._cp1252_char(b) for b in clean.encode("utf-8"))
    got = _apply(spark, X.fix_mojibake, [garbled, clean, None])
    assert got == [clean, clean, None]


def test_idempotence(spark):
    vals = ["  a  b ", "TP. HCM", "hòa", "a,,,,b....", "Ã¡o"]
    for fn in [X.collapse_ws, X.normalize_tone, X.fix_mojibake]:
        once = _apply(spark, fn, vals)
        assert _apply(spark, fn, once) == once


def test_whitespace_class_is_pythons(spark):
    ws = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    others = ["\u200b", "\u00ad", "x", "\u180e"]
    vals = [f"a{c}{c}b" for c in ws + others]
    assert _apply(spark, X.collapse_ws, vals) == [py_collapse(v) for v in vals]


def test_language_hash_wordcount(spark):
    df = spark.createDataFrame([("Xin chào các bạn",), ("hello world",), ("",), (None,)], "s string")
    rows = df.select(X.detect_language("s"), X.word_count("s"), X.content_hash("s")).collect()
    assert [r[0] for r in rows] == ["vi", "en", "en", "en"]
    assert [r[1] for r in rows] == [4, 2, 0, None]
    assert rows[2][2] is None and rows[3][2] is None and len(rows[0][2]) == 32


def test_parse_json_block(spark):
    df = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('Sure: {"a": 2} ok',), ("nothing",)], "s string")
    rows = df.select(X.parse_json_block("s").alias("p")).select(
        F.variant_get("p.value", "$.a", "int").alias("a"), "p.parse_error").collect()
    assert [(r.a, r.parse_error) for r in rows] == [(1, False), (2, False), (None, True)]


def test_decode_bytes(spark):
    data = [(bytearray("Việt".encode("utf-8")),), (bytearray("café €".encode("cp1252")),)]
    df = spark.createDataFrame(data, "b binary")
    assert [r[0] for r in df.select(X.decode_bytes("b")).collect()] == ["Việt", "café €"]


def test_sql_functions_match_model(spark):
    from silverline.functions.sql_functions import register_sql_functions

    register_sql_functions(spark)
    spark.createDataFrame([(v,) for v in EDGE], "s string").createOrReplaceTempView("edge_rows")
    rows = spark.sql("select s, deep_normalize(s) as d, collapse_ws(s) as c, fix_mojibake(s) as m "
                     "from edge_rows").collect()
    assert [r.d for r in rows] == [py_deep(r.s) for r in rows]
    assert [r.c for r in rows] == [py_collapse(r.s) for r in rows]
    assert [r.m for r in rows] == [r.s for r in rows]
    got = spark.sql("select clean_date('3/4/24') as d, clean_integer('2.5') as i, is_valid_for_type('có', 'boolean') as b, "
                    "pattern_is('012345678901', 'cleaner_cccd') as c").first()
    assert str(got.d.date()) == "2024-04-03" and got.i == 2 and got.b is True and got.c is True


def test_all_sql_functions_registered(spark):
    from silverline.functions.sql_functions import definitions, register_sql_functions

    names = register_sql_functions(spark, prefix="t_")
    assert names == ["t_" + d[0] for d in definitions()]
    row = spark.sql("select t_sql_type('money') as a, t_normalize_phone('09 12.34-5') as b, "
                    "t_markup_to_text('<p>a</p>\\n<b>b</b>') as c, t_question_hash('ABC') = md5('abc') as d").first()
    assert (row.a, row.b, row.c, row.d) == ("DOUBLE", "0912345", "a b", True)

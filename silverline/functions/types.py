"""Pattern tests, validity checks and typed parsing (FLT4, FLT5, TYP5-TYP8, TYP10).

Each function returns a Catalyst expression.  Numbers are parsed with
``try_cast`` behind a plain-number regex, so Spark and DuckDB accept exactly the
same strings (``1_000``, ``1d``, ``nan`` and ``inf`` are all rejected).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silverline.functions import patterns as P
from silverline.functions.text import strip_ws


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _drop(col: Column, *literals: str) -> Column:
    out = col
    for s in literals:
        out = F.replace(out, F.lit(s), F.lit(""))
    return out


# ---------------------------------------------------------------------------
# FLT4 anchored patterns
# ---------------------------------------------------------------------------


def pattern_is(col, kind: str, cleaner: bool = False) -> Column:
    """FLT4: anchored pattern test (phone, email, date_vn, money_vn, percentage,
    and with ``cleaner=True`` the cleaner's phone/money/cccd/tax_code)."""
    table = P.CLEANER_PATTERNS if cleaner else P.VALIDATOR_PATTERNS
    return _c(col).rlike(table[kind])


def plain_number(s: Column) -> Column:
    """A string both engines cast to the same double."""
    return F.when(s.rlike(P.PLAIN_NUMBER), s.try_cast("double"))


# ---------------------------------------------------------------------------
# FLT5 validity per semantic type
# ---------------------------------------------------------------------------


def is_valid_for_type(col, semantic_type: str) -> Column:
    """FLT5: True when a value is valid for ``semantic_type``; null counts as valid.

    numeric: parses after dropping ``,`` and spaces; integer: parses after
    dropping ``,``; date/phone/email/money: anchored pattern; boolean: one of the
    boolean words; anything else: always valid.
    """
    c = _c(col)
    s = strip_ws(c.cast("string"))
    if semantic_type == "numeric":
        ok = plain_number(_drop(s, ",", " ")).isNotNull()
    elif semantic_type == "integer":
        ok = plain_number(_drop(s, ",")).isNotNull()
    elif semantic_type == "date":
        ok = s.rlike(P.VALIDATOR_PATTERNS["date_vn"])
    elif semantic_type == "phone":
        ok = s.rlike(P.VALIDATOR_PATTERNS["phone"])
    elif semantic_type == "email":
        ok = s.rlike(P.VALIDATOR_PATTERNS["email"])
    elif semantic_type == "money":
        ok = s.rlike(P.VALIDATOR_PATTERNS["money_vn"])
    elif semantic_type == "boolean":
        ok = F.lower(s).isin(*P.BOOLEAN_WORDS)
    else:
        return F.lit(True)
    return c.isNull() | F.coalesce(ok, F.lit(False))


# ---------------------------------------------------------------------------
# TYP5-TYP8 typed cleaning
# ---------------------------------------------------------------------------


def clean_numeric(col) -> Column:
    """TYP5: drop ``, space đ VND $`` and parse as double; bad values -> null."""
    c = _c(col)
    return plain_number(_drop(c.cast("string"), ",", " ", "đ", "VND", "$"))


def clean_integer(col) -> Column:
    """TYP6: TYP5 then round half to even -> bigint."""
    return F.bround(clean_numeric(col), 0).try_cast("bigint")


#: (shape regex, Spark datetime pattern) in the order they are tried; day first.
DATE_FORMATS = [
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy"),
    (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "d-M-yyyy"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$", "d/M/yy"),
    (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{2}$", "d-M-yy"),
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"),
    (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "yyyy/M/d"),
]


def clean_date(col) -> Column:
    """TYP7: day-first date text -> TIMESTAMP_NTZ; impossible dates -> null.

    ISO ``yyyy-M-d`` stays year-month-day; two-digit years are 2000-2099.
    """
    c = _c(col)
    s = strip_ws(c.cast("string"))
    parsed = [F.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(fmt))) for shape, fmt in DATE_FORMATS]
    return F.coalesce(*parsed).cast("timestamp_ntz")


def clean_money(col) -> Column:
    """TYP8: Vietnamese money text: drop ``,`` and ``.`` (thousands) and the unit."""
    c = _c(col)
    dropped = _drop(c.cast("string"), ",", ".", "đ", "VND", "đồng", " ")
    return plain_number(strip_ws(dropped))


def sql_type(semantic_col) -> Column:
    """TYP10: semantic type -> SQL type name (default VARCHAR)."""
    c = _c(semantic_col)
    out = F.lit(P.DEFAULT_SQL_TYPE)
    for sem, sql in reversed(P.SEMANTIC_SQL_TYPES):
        out = F.when(c == sem, F.lit(sql)).otherwise(out)
    return out


def sql_type_of_dtype(dtype: T.DataType) -> str:
    """TYP10 (table variant): Spark type -> SQL type of the published schema."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "INTEGER"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "DOUBLE"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "TIMESTAMP"
    if isinstance(dtype, T.BooleanType):
        return "BOOLEAN"
    return "VARCHAR"


def semantic_of_dtype(dtype: T.DataType) -> str | None:
    """Semantic type fixed by the storage type alone, else None (decided by patterns)."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "numeric"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return None


def apply_typed(col, semantic_type: str) -> Column:
    """TYP9 for one column: the cleaning the semantic type calls for."""
    c = _c(col)
    if semantic_type == "numeric":
        return clean_numeric(c)
    if semantic_type == "integer":
        return clean_integer(c)
    if semantic_type == "date":
        return clean_date(c)
    if semantic_type == "money":
        return clean_money(c)
    if semantic_type == "phone":
        from silverline.functions.text import normalize_phone

        return normalize_phone(c)
    return c

"""Fixed values that must equal the reference's for identical results.

Everything in the FIXED VALUES block below is data, stated once, in the
reference's natural order.  Code elsewhere builds Spark (Java regex) and
DuckDB (RE2) expressions from it.  Character classes are spelled out
explicitly (``[\\p{L}\\p{N}_]`` for a word character, a generated whitespace
class) so that Java, RE2 and Python agree on non-ASCII text.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference's values)
# ---------------------------------------------------------------------------

#: Vietnamese letters counted by language detection, lower case.
VIETNAMESE_LETTERS = (
    "àáảãạăắằẳẵặâấầẩẫậèéẻẽẹêếềểễệìíỉĩịòóỏõọôốồổỗộơớờởỡợùúủũụưứừửữựỳýỷỹỵđ"
)

#: Tone-mark placement fixes, applied in this order as literal replacements.
TONE_PAIRS = [
    ("òa", "oà"), ("ỏà", "oả"), ("õà", "oã"), ("óà", "oá"), ("òà", "oà"), ("ọà", "oạ"),
    ("òe", "oè"), ("ỏe", "oẻ"), ("õe", "oẽ"), ("óe", "oé"), ("ọe", "oẹ"),
    ("ùy", "uỳ"), ("ủy", "uỷ"), ("ũy", "uỹ"), ("úy", "uý"), ("ụy", "uỵ"),
]

#: Address abbreviations, in this order: (abbreviation, optional trailing dot, expansion).
#: Each is matched case-insensitively between word boundaries.
ADDRESS_ABBREVIATIONS = [
    ("TP", True, "Thành phố"),
    ("TT", True, "Thị trấn"),
    ("H", True, "Huyện"),
    ("Q", True, "Quận"),
    ("P", True, "Phường"),
    ("X", True, "Xã"),
    ("Đ", True, "Đường"),
    ("ĐT", False, "Điện thoại"),
    ("SĐT", False, "Số điện thoại"),
    ("Khu CN", False, "Khu công nghiệp"),
    ("KCN", False, "Khu công nghiệp"),
]

#: Currency words rewritten to the canonical symbol (case-insensitive, whole words).
CURRENCY_WORDS = ["VND", "vnđ", "vn đ", "đ", "đồng"]
CURRENCY_CANONICAL = "VNĐ"

#: Words accepted as booleans by the validator (compared lower case).
BOOLEAN_WORDS = ["true", "false", "0", "1", "yes", "no", "có", "không"]

#: Intent pattern lists of the question router, in order.
NUMERIC_INTENT = [
    r"bao nhiêu", r"mức (phạt|lương|giá)", r"số (lượng|tiền)",
    r"tổng cộng", r"giá trị", r"\d+", r"chi phí", r"ngân sách",
    r"số liệu", r"thống kê", r"con số", r"percentage", r"phần trăm",
]
AGGREGATE_INTENT = [
    r"tổng", r"trung bình", r"max|min", r"cao nhất", r"thấp nhất",
    r"sum|count|avg", r"đếm", r"tổng kết",
]
LIST_INTENT = [
    r"liệt kê", r"danh sách", r"những (gì|ai|nào)", r"các (loại|mục)",
    r"list", r"tất cả", r"có những", r"gồm những",
]
LOOKUP_INTENT = [
    r"tìm", r"tra cứu", r"thông tin (về|của)", r"tên", r"địa chỉ",
    r"số điện thoại", r"email", r"ngày", r"where is", r"how to find",
]
#: Phrase that turns a list question into a document listing.
DOCUMENT_LIST_PHRASE = "tài liệu"

#: Plan limits: plan -> (queries per month, storage MB, requests per minute); -1 = unlimited.
PLAN_LIMITS = [
    ("starter", 1000, 100, 10),
    ("pro", 50000, 5120, 100),
    ("business", 500000, 51200, 500),
    ("enterprise", -1, -1, 10000),
]
DEFAULT_PLAN = "starter"

#: Semantic type -> SQL type of a gold column.
SEMANTIC_SQL_TYPES = [
    ("numeric", "DOUBLE"), ("integer", "BIGINT"), ("text", "VARCHAR"),
    ("date", "TIMESTAMP"), ("datetime", "TIMESTAMP"), ("boolean", "BOOLEAN"),
    ("money", "DOUBLE"), ("phone", "VARCHAR"), ("email", "VARCHAR"), ("unknown", "VARCHAR"),
]
DEFAULT_SQL_TYPE = "VARCHAR"

#: Quality thresholds (score is a percentage).
GOLD_MIN_SCORE = 95.0
SILVER_MIN_SCORE = 80.0
LOW_VALIDITY_ISSUE = 90.0
#: Share of sampled values that must match a pattern for a type to be inferred.
INFER_SHARE = 0.7
#: Share of all rows that must convert before a column is coerced.
COERCE_SHARE = 0.8
#: Strings longer than this are flagged by the anomaly report.
LONG_STRING_CHARS = 10000
#: Per-file context budget: min(CONTEXT_MAX_CHARS, CONTEXT_TOTAL_CHARS div files).
CONTEXT_MAX_CHARS = 8000
CONTEXT_TOTAL_CHARS = 50000
#: Raw-document excerpt length of the external documents listing.
RAW_DOCUMENT_CHARS = 10000

#: Report texts (printf-style templates), in the order the reports emit them.
MESSAGES = {
    "not_numeric": "%d values cannot be converted to number",
    "high_nulls": "High null rate: %d/%d",
    "low_validity": "Column '%s' has low validity: %.1f%%",
    "rec_below_80": "⚠️ Data quality below 80%. Review source data before using for queries.",
    "rec_fill_nulls": "📊 Column '%s': Consider filling or removing null values",
    "rec_needs_cleaning": "🔧 Column '%s': %d values need cleaning",
    "rec_excellent": "✅ Excellent data quality! Ready for Gold Layer promotion.",
    "rec_good": "👍 Good data quality. Minor cleanup recommended.",
    "warn_nulls": "Column '%s': %d null values (%.1f%%)",
    "warn_long": "Column '%s': %d extremely long values (>10000 chars)",
    "warn_empty": "Column '%s': %d empty string values",
    "err_rows": "Row count decreased: %d -> %d (%d lost)",
    "err_columns": "Column count decreased: %d -> %d",
    "warn_non_null": "Non-null value count changed: %d -> %d",
}
#: Recommendation thresholds: score below, null share above, invalid count above, score at least.
REC_LOW_SCORE = 80.0
REC_NULL_SHARE = 0.3
REC_INVALID_COUNT = 10
REC_GOOD_SCORE = 85.0
HIGH_NULL_SHARE = 0.5
LOW_QUALITY_NULL_SHARE = 0.4
#: Context hint types and the context block layout.
HINT_MULTIPLE_SOURCES = "multiple_sources"
HINT_MULTIPLE_MATCHES = "multiple_matches"
CONTEXT_HEADER = ("=== ", " ===\n")
CONTEXT_SEPARATOR = "\n\n"
FILE_BULLET = "• "

# ---------------------------------------------------------------------------
# Portable character classes (same meaning in Java, RE2 and Python's ``re``)
# ---------------------------------------------------------------------------

#: A word character as Python's Unicode ``\w`` sees it.
WORD = r"[\p{L}\p{N}_]"


def _whitespace_class(negate: bool = False) -> str:
    """Character class of exactly the code points Python's ``str.isspace`` accepts.

    Built from the rule (not transcribed), written with ``\\x{..}`` escapes that
    Java and RE2 both read.
    """
    points = [c for c in range(0x3001) if chr(c).isspace()]
    ranges: list[tuple[int, int]] = []
    for c in points:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1] = (ranges[-1][0], c)
        else:
            ranges.append((c, c))
    parts = []
    for a, b in ranges:
        parts.append(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}")
    return "[" + ("^" if negate else "") + "".join(parts) + "]"


#: Java form: Unicode White_Space plus the four separators (U+001C-U+001F) Python also treats
#: as space - one property test instead of a dozen ranges.  ``WHITESPACE_RE2`` spells out the
#: same code points for RE2 (DuckDB), which has no White_Space property.
WHITESPACE_BODY = r"\p{IsWhite_Space}\x{1c}-\x{1f}"
WHITESPACE = "[" + WHITESPACE_BODY + "]"
WHITESPACE_RE2 = _whitespace_class()
#: The same code points as a plain string (for character-set ``trim``).
WHITESPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def to_re2(pattern: str) -> str:
    """The RE2 spelling of a pattern built here (only the whitespace class differs)."""
    return pattern.replace(WHITESPACE_BODY, WHITESPACE_RE2[1:-1])


def py_to_portable(pattern: str) -> str:
    """Rewrite Python-regex shorthands ``\\w \\d \\s`` as explicit Unicode classes.

    Handles the shorthands both outside and inside ``[...]`` classes, which is all
    the fixed patterns above use.
    """
    out = []
    i = 0
    in_class = False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            body = {"w": r"\p{L}\p{N}_", "d": r"\p{Nd}", "s": WHITESPACE[1:-1]}.get(nxt)
            if body is not None:
                out.append(body if in_class else "[" + body + "]")
            else:
                out.append(pattern[i:i + 2])
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


# Validator patterns (anchored), Python notation as in the reference, in its order.
_VALIDATOR_PY = {
    "phone": r"^(0|\+84)[0-9]{9,10}$",
    "email": r"^[\w\.-]+@[\w\.-]+\.\w+$",
    "date_vn": r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$",
    "money_vn": r"^[\d\.,]+\s*(đ|VND|đồng)?$",
    "percentage": r"^\d+(\.\d+)?\s*%?$",
}
# Cleaner patterns (declared by the reference's cleaner; cccd and tax codes only there).
_CLEANER_PY = {
    "phone": r"^(0|\+84|84)[0-9]{9,10}$",
    "email": r"^[\w\.-]+@[\w\.-]+\.\w+$",
    "date_vn": r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$",
    "money": r"^[\d\.,]+\s*(đ|VND|đồng|vnđ)?$",
    "cccd": r"^[0-9]{12}$",
    "tax_code": r"^[0-9]{10,13}$",
}
# Column-type detection of the cleaner.
_DETECT_NUMERIC_PY = r"^-?[\d.]+$"
_DETECT_DATES_PY = [r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$", r"^\d{4}[/-]\d{1,2}[/-]\d{1,2}$"]

VALIDATOR_PATTERNS = {k: py_to_portable(v) for k, v in _VALIDATOR_PY.items()}
CLEANER_PATTERNS = {k: py_to_portable(v) for k, v in _CLEANER_PY.items()}
DETECT_NUMERIC = py_to_portable(_DETECT_NUMERIC_PY)
DETECT_DATES = [py_to_portable(p) for p in _DETECT_DATES_PY]

#: A number Spark's and DuckDB's casts both read the same way (our rule, SURVEY 7.4 #7).
PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

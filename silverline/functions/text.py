"""Text repair and normalization as Catalyst expressions (Column -> Column).

All functions are built-in Spark expressions (regexp_replace, replace,
translate, md5 ...), so they stay inside whole-stage code generation; no
Python runs per row.  Regexes are Java regexes whose character classes are
spelled out (see ``patterns``) so they agree with Python's Unicode ``re``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from silverline.functions import patterns as P
from silverline.functions import sqltext as Q


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _lit(s: str) -> Column:
    return F.lit(s)


def _named(col) -> str | None:
    """SQL identifier when ``col`` is a column name (the one-call SQL-text path), else None."""
    return Q.ident(col) if isinstance(col, str) else None


def _guarded(col, guard: str, chain) -> Column:
    """``chain(x)`` where ``x`` matches ``guard``, else ``x`` - with ``x`` evaluated ONCE.

    ``x`` is bound as the variable of a one-element ``transform`` (a let-binding):
    written as ``when(x rlike g, chain(x)).otherwise(x)`` the input expression would be
    copied three times and nested steps would re-run their inputs many times over.
    """
    return F.transform(F.array(_c(col)), lambda v: F.when(v.rlike(guard), chain(v)).otherwise(v))[0]


# ---------------------------------------------------------------------------
# Regex helpers
# ---------------------------------------------------------------------------

def java_quote(text: str) -> str:
    """Escape regex metacharacters of a literal for a Java pattern."""
    return "".join("\\" + ch if ch in r".^$|?*+()[]{}\\" else ch for ch in text)


def strip_ws(col) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends (character-set trim, no regex)."""
    return F.trim(_c(col), F.lit(P.WHITESPACE_CHARS))


# ---------------------------------------------------------------------------
# TXT1 fix_mojibake
# ---------------------------------------------------------------------------


def _cp1252_char(byte: int) -> str:
    try:
        return bytes([byte]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(byte)  # bytes cp1252 leaves undefined read as C1 controls


def mojibake_pairs(include_upper: bool = True, legacy_space_a_grave: bool = False):
    """(garbled, correct) pairs: each Vietnamese letter's UTF-8 bytes read as cp1252.

    Built from the rule, longest garbled form first, so that a sequential chain of
    literal replacements equals one simultaneous replacement (UTF-8 is prefix-free,
    and no output of a later pair can complete an earlier, longer key).
    ``legacy_space_a_grave`` adds the reference's non-standard ``"Ã "`` -> ``à``
    (a plain space instead of the no-break space) after all others.
    """
    letters = P.VIETNAMESE_LETTERS + (P.VIETNAMESE_LETTERS.upper() if include_upper else "")
    pairs = {}
    for letter in dict.fromkeys(letters):
        garbled = "".join(_cp1252_char(b) for b in letter.encode("utf-8"))
        if garbled != letter:
            pairs[garbled] = letter
    out = sorted(pairs.items(), key=lambda kv: (-len(kv[0]), kv[0]))
    if legacy_space_a_grave:
        out.append(("Ã ", "à"))
    return out


#: First characters of every garbled form; rows without them skip the replace chain.
MOJIBAKE_GUARD = "[ÃÄÅÆ]|á[º»]"


def fix_mojibake(col, include_upper: bool = True, legacy_space_a_grave: bool = False) -> Column:
    """TXT1: repair Vietnamese text that was UTF-8 decoded as cp1252."""
    pairs = mojibake_pairs(include_upper, legacy_space_a_grave)
    if _named(col):
        return F.expr(Q.guarded(_named(col), MOJIBAKE_GUARD, Q.replace_chain(pairs)))

    def chain(v):
        for bad, good in pairs:
            v = F.replace(v, _lit(bad), _lit(good))
        return v

    return _guarded(col, MOJIBAKE_GUARD, chain)


# ---------------------------------------------------------------------------
# TXT2 collapse_ws, TXT3-7 Vietnamese normalization
# ---------------------------------------------------------------------------


def collapse_ws(col) -> Column:
    """TXT2: trim and turn every whitespace run (newlines too) into one space."""
    if _named(col):
        return F.expr(Q.collapse(_named(col)))
    return F.trim(F.regexp_replace(_c(col), P.WHITESPACE + "+", " "))


def _first_char_guard(pairs) -> str:
    """Regex that finds any of the pairs' search strings (first two characters as classes)."""
    firsts = sorted({a[0] for a, _ in pairs})
    seconds = sorted({a[1] for a, _ in pairs})
    return f"[{''.join(firsts)}][{''.join(seconds)}]"


#: Rows without a candidate two-letter sequence skip the replace chain.
TONE_GUARD = _first_char_guard(P.TONE_PAIRS)


def normalize_tone(col) -> Column:
    """TXT3: move tone marks to the main vowel (16 literal replacements, in order)."""
    if _named(col):
        return F.expr(Q.guarded(_named(col), TONE_GUARD, Q.replace_chain(P.TONE_PAIRS)))

    def chain(v):
        for old, new in P.TONE_PAIRS:
            v = F.replace(v, _lit(old), _lit(new))
        return v

    return _guarded(col, TONE_GUARD, chain)


#: Python's ``\b`` before a word character / after one, as lookarounds (no zero-width alternation).
_BEFORE_WORD = f"(?<!{P.WORD})"
_AFTER_WORD = f"(?!{P.WORD})"


def _word_bounded(body_regex: str, optional_dot: bool) -> str:
    r"""``\b body \.? \b`` for a body that starts and ends with a word character.

    The leading ``\b`` can only be "no word character before"; the trailing one is
    "a word character follows" after a consumed dot, else "no word character follows".
    Same matches, same backtracking order as Python's ``re``.
    """
    tail = f"(?:\\.(?={P.WORD})|{_AFTER_WORD})" if optional_dot else _AFTER_WORD
    return f"{_BEFORE_WORD}{body_regex}{tail}"


def address_regexes():
    """(java_regex, replacement) for TXT4, in order."""
    return [(f"(?iu){_word_bounded(java_quote(abbr), dot)}", expansion)
            for abbr, dot, expansion in P.ADDRESS_ABBREVIATIONS]


#: One pass that finds any abbreviation; texts without one skip the whole chain (no
#: expansion contains a stand-alone abbreviation, so nothing can appear later in the chain).
ADDRESS_GUARD = "(?iu)" + _word_bounded(
    "(?:" + "|".join(java_quote(a) for a, _, _ in sorted(P.ADDRESS_ABBREVIATIONS, key=lambda t: -len(t[0]))) + ")",
    True)


def expand_address(col) -> Column:
    """TXT4: expand Vietnamese address abbreviations (case-insensitive, word-bounded)."""
    if _named(col):
        return F.expr(Q.guarded(_named(col), ADDRESS_GUARD, Q.regex_chain(address_regexes())))

    def chain(v):
        for rx, rep in address_regexes():
            v = F.regexp_replace(v, rx, rep)
        return v

    return _guarded(col, ADDRESS_GUARD, chain)


def currency_regexes():
    words = "(?:" + "|".join(java_quote(w) for w in P.CURRENCY_WORDS) + ")"
    first = (f"(?iu){_BEFORE_WORD}{words}{_AFTER_WORD}", P.CURRENCY_CANONICAL)
    second = (f"([\\p{{Nd}}\\.,]+){P.WHITESPACE}*{java_quote(P.CURRENCY_CANONICAL)}",
              "$1 " + P.CURRENCY_CANONICAL)
    return [first, second]


#: Rows with neither a currency word nor the canonical symbol are left as they are.
CURRENCY_GUARD = f"(?iu){_BEFORE_WORD}(?:" + "|".join(java_quote(w) for w in P.CURRENCY_WORDS) + \
    f"){_AFTER_WORD}|{java_quote(P.CURRENCY_CANONICAL)}"


def normalize_currency(col) -> Column:
    """TXT5: currency words -> VNĐ, then exactly one space between amount and VNĐ."""
    if _named(col):
        return F.expr(Q.guarded(_named(col), CURRENCY_GUARD, Q.regex_chain(currency_regexes())))

    def chain(v):
        for rx, rep in currency_regexes():
            v = F.regexp_replace(v, rx, rep)
        return v

    return _guarded(col, CURRENCY_GUARD, chain)


def ocr_noise_regexes():
    ws = P.WHITESPACE
    return [
        (",{2,}", ","),
        ("\\.{4,}", "..."),
        (f"(?md)^[|I1]{ws}+", ""),
        (f"(?md){ws}+[|I1]$", ""),
    ]


def remove_ocr_noise(col) -> Column:
    """TXT6: repeated commas/dots and stray ``|``, ``I``, ``1`` at line ends."""
    out = _c(col)
    for rx, rep in ocr_noise_regexes():
        out = F.regexp_replace(out, rx, rep)
    return out


def deep_normalize(col) -> Column:
    """TXT7: tone -> address -> currency -> OCR noise -> strip."""
    if _named(col):
        x = Q.guarded(_named(col), TONE_GUARD, Q.replace_chain(P.TONE_PAIRS))
        x = Q.guarded(x, ADDRESS_GUARD, Q.regex_chain(address_regexes()))
        x = Q.guarded(x, CURRENCY_GUARD, Q.regex_chain(currency_regexes()))
        return F.expr(Q.strip(Q.regex_chain(ocr_noise_regexes())(x)))
    c = _c(col)
    return strip_ws(remove_ocr_noise(normalize_currency(expand_address(normalize_tone(c)))))


# ---------------------------------------------------------------------------
# TXT8-16 scalar helpers
# ---------------------------------------------------------------------------


def vietnamese_letter_count(col) -> Column:
    low = F.lower(_c(col))
    return F.length(low) - F.length(F.translate(low, P.VIETNAMESE_LETTERS, ""))


def detect_language(col) -> Column:
    """TXT8: 'vi' when Vietnamese letters exceed 1 % of the characters, else 'en'."""
    c = _c(col)
    return F.when(vietnamese_letter_count(c) > F.length(c) * F.lit(0.01), F.lit("vi")).otherwise(F.lit("en"))


def content_hash(col) -> Column:
    """TXT9: md5 of the whole text; null for null or empty text."""
    c = _c(col)
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("string")).otherwise(F.md5(c))


def question_hash(col) -> Column:
    """TXT10: md5 of the lower-cased question (cache key)."""
    return F.md5(F.lower(_c(col)))


def parse_json_block(col) -> Column:
    """TXT11: parse a model answer: drop a ``` fence, else take the outer {...} span.

    Returns a struct ``(value variant, parse_error boolean)``.
    """
    t = strip_ws(_c(col))
    fenced = t.startswith("```")
    # drop the first line; drop the last line when it is exactly ```
    no_first = F.regexp_replace(t, "^[^\\n]*(\\n|\\z)", "")
    body = F.when(fenced, F.regexp_replace(no_first, "(^|\\n)```\\z", "")).otherwise(t)
    body = F.when(body.startswith("json"), strip_ws(F.substring(body, 5, 1 << 30))).otherwise(body)
    direct = F.try_parse_json(body)
    span = F.try_parse_json(F.regexp_extract(body, "(?s)\\{.*\\}", 0))
    value = F.coalesce(direct, span)
    return F.struct(value.alias("value"), value.isNull().alias("parse_error"))


def truncate_text(col, n: int) -> Column:
    """TXT12: first ``n`` characters (the definition of a context budget)."""
    return F.substring(_c(col), 1, n)


def word_count(col) -> Column:
    """TXT13: number of whitespace-separated tokens (``len(s.split())``)."""
    collapsed = collapse_ws(col)
    return F.when(collapsed.isNull(), F.lit(None).cast("bigint")).when(collapsed == "", F.lit(0).cast("bigint")).otherwise(
        (F.length(collapsed) - F.length(F.replace(collapsed, F.lit(" "), F.lit(""))) + 1).cast("bigint"))


def normalize_phone(col) -> Column:
    """TXT15: drop spaces, dashes and dots from a phone number."""
    return F.translate(_c(col), " -.", "")


def _cp1252_c1_maps():
    src = "".join(chr(b) for b in range(0x80, 0xA0))
    dst = "".join(_cp1252_char(b) for b in range(0x80, 0xA0))
    return src, dst


def decode_bytes(col) -> Column:
    """TXT16: binary -> text: strict UTF-8 when valid, else Windows-1252.

    Spark's ``decode`` has no windows-1252, so the fallback reads ISO-8859-1 and
    maps the 32 C1 positions to their cp1252 characters with ``translate``.
    """
    b = _c(col)
    as_utf8 = b.cast("string")
    src, dst = _cp1252_c1_maps()
    latin = F.translate(F.decode(b, "ISO-8859-1"), src, dst)
    return F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(latin)


def markup_to_text(col, max_chars: int | None = None, separator: str = " ") -> Column:
    """SRC7: strip tags, collapse whitespace; optional cap (none by default: whole text)."""
    out = collapse_ws(F.regexp_replace(_c(col), "<[^>]+>", separator))
    return truncate_text(out, max_chars) if max_chars else out


def row_to_text(*cols) -> Column:
    """PRJ6: non-null values joined by one space (``concat_ws`` skips nulls)."""
    return F.concat_ws(" ", *[_c(c).cast("string") for c in cols])

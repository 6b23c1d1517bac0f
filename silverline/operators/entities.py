"""TXT14 extract_entities: one row per phone / e-mail / date / money instance in a text, with its offset.

The reference asks a model for these on the first 5,000 characters; here a
regex runs over every whole text, fully inside the JVM.  A rule's matches and the gaps
between them come from the same regex, so the running sum of their lengths is the offset of
each match, also of equal values.  Texts without a rule's marking characters skip its regex.
Contexts are cut before the matches become rows, so no text travels with a match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverline.functions import patterns as P

_W = r"\p{L}\p{N}_"
#: (kind, regex, group holding the value)
ENTITY_RULES = [
    ("email", f"([{_W}.-]+@[{_W}.-]+\\.[{_W}]+)", 1),
    ("phone", r"(\+[0-9]{1,3} ?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|(?:\+84|0)[0-9]{9,10})", 1),
    ("date", r"(?:^|[^0-9])([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4})", 1),
    ("money", f"([0-9][0-9.,]*{P.WHITESPACE}?(?:VNĐ|VND|đồng|đ))", 1),
]
#: the same matches for Java's engine: a run is tried from its start (or the end of the last match) only, and never given back
_JAVA = {"email": f"(?:\\G|(?<![{_W}.-]))[{_W}.-]++@[{_W}.-]+\\.[{_W}]+"}
#: what a text must hold for a rule to match
_MARKS = {"email": ["@"], "phone": ["+", "0"], "date": ["/", "-"], "money": ["VN", "đ"]}


def extract_entities(df: DataFrame, text_col: str, keys: list[str], context_chars: int = 30) -> DataFrame:
    """Rows (keys..., kind, ordinal, value, offset, position, context).

    ``offset`` is the 1-based place of the value's first character, ``position`` the third of the text
    (start/middle/end) it lies in, ``context`` the value with ``context_chars`` characters on each side.
    """
    def marked(kind):
        found = [F.contains(F.col("__t"), F.lit(m)) for m in _MARKS[kind]]
        return found[0] | found[1] if len(found) > 1 else found[0]

    rules = {kind: _JAVA.get(kind, rx) for kind, rx, _ in ENTITY_RULES}
    # each step reads the columns of the one before, so every regex runs once
    texts = df.select(*keys, F.col(text_col).alias("__t"))
    matched = texts.select("*", *[F.when(marked(kind), F.regexp_extract_all("__t", F.lit(rx), F.lit(0))).alias(f"__m_{kind}") for kind, rx in rules.items()])
    cut = matched.select("*", *[F.when(F.size(f"__m_{kind}") > 0, F.split("__t", rx, -1)).alias(f"__g_{kind}") for kind, rx in rules.items()])
    found = cut.select(*keys, "__t", *[F.expr(_offsets(kind)).alias(f"__f_{kind}") for kind in rules])
    rows = F.concat(*[F.coalesce(F.expr(_rows(kind, context_chars)), F.expr(f"cast(array() as array<{_ROW}>)")) for kind in rules])
    return found.select(*keys, F.inline(rows))


_FOUND = "struct<ordinal:int,value:string,at:int>"
_ROW = "struct<kind:string,ordinal:int,value:string,offset:int,position:string,context:string>"


def _offsets(kind: str) -> str:
    """Matches with their offsets: gap, match, gap, match, ... with a running length."""
    w, g = f"x.__m_{kind}", f"x.__g_{kind}"
    # a date's match may begin with the character before it
    value = f"if({w} rlike '^[0-9]', {w}, substring({w}, 2))" if kind == "date" else w
    step = (f"named_struct('n', acc.n + 1, 'upto', acc.upto + length({g}) + length({w}), 'found', array_append(acc.found, "
            f"named_struct('ordinal', acc.n + 1, 'value', {value}, 'at', acc.upto + length({g}) + length({w}) - length({value}) + 1)))")
    return (f"aggregate(arrays_zip(__g_{kind}, __m_{kind}), named_struct('n', 0, 'upto', 0, 'found', cast(array() as array<{_FOUND}>)), "
            f"(acc, x) -> if({w} is null, acc, {step}), acc -> acc.found)")


def _rows(kind: str, context_chars: int) -> str:
    third = "case when f.at * 3 <= length(__t) then 'start' when f.at * 3 <= 2 * length(__t) then 'middle' else 'end' end"
    context = f"substring(__t, greatest(1, f.at - {context_chars}), length(f.value) + {2 * context_chars})"
    return (f"transform(__f_{kind}, f -> named_struct('kind', '{kind}', 'ordinal', f.ordinal, 'value', f.value, 'offset', f.at, "
            f"'position', {third}, 'context', {context}))")

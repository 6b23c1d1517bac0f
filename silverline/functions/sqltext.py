"""The same expressions as Spark SQL text, for building wide plans in one call.

A plan with hundreds of aggregates built Column by Column costs one Python ->
JVM round trip per function call; written as SQL text, each aggregate is a
single ``F.expr`` and the JVM parser builds the identical Catalyst tree.
"""

from __future__ import annotations

from silverline.functions import patterns as P


def lit(s: str) -> str:
    """Spark SQL string literal (backslashes and quotes escaped)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def strip(x: str) -> str:
    return f"trim(BOTH {lit(P.WHITESPACE_CHARS)} FROM {x})"


def rlike(x: str, pattern: str) -> str:
    return f"coalesce({x} RLIKE {lit(pattern)}, false)"


def drop(x: str, *chars: str) -> str:
    for c in chars:
        x = f"replace({x}, {lit(c)}, '')"
    return x


def plain_number(x: str) -> str:
    return f"CASE WHEN {x} RLIKE {lit(P.PLAIN_NUMBER)} THEN try_cast({x} AS DOUBLE) END"


def count_if(cond: str) -> str:
    return f"CAST(count_if({cond}) AS BIGINT)"


# ---------------------------------------------------------------------------
# Text steps (same rules as functions.text, for a named column)
# ---------------------------------------------------------------------------

def guarded(x: str, guard: str, chain) -> str:
    """``chain(v)`` where ``v`` matches ``guard``, else ``v``; ``v`` is bound once (lambda variable)."""
    return f"transform(array({x}), v -> CASE WHEN v RLIKE {lit(guard)} THEN {chain('v')} ELSE v END)[0]"


def replace_chain(pairs):
    def chain(v: str) -> str:
        for a, b in pairs:
            v = f"replace({v}, {lit(a)}, {lit(b)})"
        return v
    return chain


def regex_chain(pairs):
    def chain(v: str) -> str:
        for rx, rep in pairs:
            v = f"regexp_replace({v}, {lit(rx)}, {lit(rep)})"
        return v
    return chain


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit(P.WHITESPACE + '+')}, ' '))"

"""DuckDB-dialect fragments for the oracle queries (same fixed patterns as Spark)."""

from __future__ import annotations

from silverline.functions import patterns as P


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rx(expr: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({expr}, {q(P.to_re2(pattern))}), false)"


def strip(expr: str) -> str:
    return f"trim({expr}, {q(P.WHITESPACE_CHARS)})"


def collapse(expr: str) -> str:
    return f"trim(regexp_replace({expr}, {q(P.WHITESPACE_RE2 + '+')}, ' ', 'g'))"


def plain_number(expr: str) -> str:
    return f"(case when regexp_matches({expr}, {q(P.PLAIN_NUMBER)}) then try_cast({expr} as double) end)"


def drop(expr: str, *lits: str) -> str:
    out = expr
    for s in lits:
        out = f"replace({out}, {q(s)}, '')"
    return out


def level(score: str) -> str:
    return (f"(case when {score} >= {P.GOLD_MIN_SCORE} then 'gold' when {score} >= {P.SILVER_MIN_SCORE} "
            f"then 'silver' else 'bronze' end)")


def valid_for_type(value: str) -> str:
    """FLT5 by the column ``expected_type``."""
    st = strip(value)
    return (f"case expected_type when 'numeric' then {plain_number(drop(st, ',', ' '))} is not null "
            f"when 'integer' then {plain_number(drop(st, ','))} is not null "
            f"when 'date' then {rx(st, P.VALIDATOR_PATTERNS['date_vn'])} "
            f"when 'phone' then {rx(st, P.VALIDATOR_PATTERNS['phone'])} "
            f"when 'email' then {rx(st, P.VALIDATOR_PATTERNS['email'])} "
            f"when 'money' then {rx(st, P.VALIDATOR_PATTERNS['money_vn'])} "
            f"when 'boolean' then lower({st}) in ({', '.join(q(w) for w in P.BOOLEAN_WORDS)}) else true end")


def column_stats_sql(table: str, columns, group_by: list[str] | None = None) -> str:
    """DuckDB twin of ``profile.column_stats`` + ``validate_columns``: one row per column."""
    group_by = group_by or []
    gsel = "".join(f"{c}, " for c in group_by)
    gby = (" group by " + ", ".join(group_by)) if group_by else ""
    parts = []
    for i, (name, typ, sem) in enumerate(columns):
        c = name
        if sem is None:
            raw = c
            st = strip(c)
            nc = f"replace({raw}, ',', '')"
            cnt = lambda cond: f"count_if({cond})"
            fields = {
                "m_numeric": cnt(rx(nc, P.DETECT_NUMERIC)),
                "m_date": cnt(rx(raw, P.VALIDATOR_PATTERNS["date_vn"])),
                "m_phone": cnt(rx(raw, P.VALIDATOR_PATTERNS["phone"])),
                "m_email": cnt(rx(raw, P.VALIDATOR_PATTERNS["email"])),
                "m_money": cnt(rx(raw, P.VALIDATOR_PATTERNS["money_vn"])),
                "v_numeric": cnt(f"{plain_number(drop(st, ',', ' '))} is not null"),
                "v_date": cnt(rx(st, P.VALIDATOR_PATTERNS["date_vn"])),
                "v_phone": cnt(rx(st, P.VALIDATOR_PATTERNS["phone"])),
                "v_email": cnt(rx(st, P.VALIDATOR_PATTERNS["email"])),
                "v_money": cnt(rx(st, P.VALIDATOR_PATTERNS["money_vn"])),
            }
            sem_sql = "null"
        else:
            fields = {k: "0" for k in ["m_numeric", "m_date", "m_phone", "m_email", "m_money",
                                       "v_numeric", "v_date", "v_phone", "v_email", "v_money"]}
            sem_sql = q(sem)
        sel = ", ".join(f"cast({v} as bigint) as {k}" for k, v in fields.items())
        parts.append(
            f"select {gsel}{i} as ordinal, {q(name)} as column_name, {q(typ)} as actual_type, "
            f"cast({sem_sql} as varchar) as dtype_semantic, count(*) as total_rows, count({c}) as non_null, {sel} "
            f"from {table}{gby}"
        )
    stats = "\nunion all\n".join(parts)
    share = P.INFER_SHARE

    def over(col):
        return f"{col} > non_null * {share}"

    expected = (
        "case when non_null = 0 then 'unknown' when dtype_semantic is not null then dtype_semantic "
        f"when {over('m_numeric')} then 'numeric' when {over('m_date')} then 'date' "
        f"when {over('m_phone')} then 'phone' when {over('m_email')} then 'email' "
        f"when {over('m_money')} then 'money' else 'text' end"
    )
    valid = (
        "case when dtype_semantic is not null then non_null when expected_type = 'numeric' then v_numeric "
        "when expected_type = 'date' then v_date when expected_type = 'phone' then v_phone "
        "when expected_type = 'email' then v_email when expected_type = 'money' then v_money else non_null end"
    )
    return f"""
select {gsel}ordinal, column_name, expected_type, actual_type, valid_count, non_null - valid_count as invalid_count,
  total_rows - non_null as null_count, total_rows,
  case when total_rows > 0 then valid_count * 100.0 / total_rows else 0.0 end as valid_percentage
from (select *, {valid} as valid_count from (select *, {expected} as expected_type from ({stats}) s0) s1) s2"""

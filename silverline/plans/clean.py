"""Bronze -> silver cleaning (CAT6) and type coercion (TYP3, TYP4).

Plan: every text step (mojibake, whitespace, Vietnamese normalization) is
fused into ONE projection; the result is written once as Parquet into the
shared checkpoint folder (lineage cut) so the expensive regex chain runs once; one aggregation
pass then decides type conversions and counts changes (a single row reaches
the driver); a final projection applies the conversions.  No row is ever
dropped, so the data-loss check can only warn about cells that became null
during conversion.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silverline.functions import patterns as P
from silverline.functions import text as X
from silverline.functions import types as TY
from silverline.operators import integrity as IN
from silverline.operators import profile as PR
from silverline.operators.columns import normalize_names
from silverline.session import materialize as materialize_table


def _is_string(dt) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def _numeric_text(c, variant: str):
    units = (",", " ", "đ", "VND") if variant == "cleaner" else (",", " ", "đ", "$")
    out = c
    for u in units:
        out = F.replace(out, F.lit(u), F.lit(""))
    return TY.plain_number(out)


def _detect_aggs(cols: list[str]) -> list:
    """Cheap anchored tests (TYP1 detection) for every string column."""
    aggs = []
    for i, name in enumerate(cols):
        c = F.col(f"`{name}`")
        no_sep = F.replace(F.replace(c, F.lit(","), F.lit("")), F.lit(" "), F.lit(""))
        aggs += [
            F.count(c).alias(f"nn{i}"),
            F.count_if(F.coalesce(no_sep.rlike(P.DETECT_NUMERIC), F.lit(False))).alias(f"dn{i}"),
            F.count_if(F.coalesce(c.rlike(P.DETECT_DATES[0]), F.lit(False))).alias(f"dd1{i}"),
            F.count_if(F.coalesce(c.rlike(P.DETECT_DATES[1]), F.lit(False))).alias(f"dd2{i}"),
        ]
    return aggs


def _convert_aggs(cols: list[str], indices, variant: str) -> list:
    """Conversion success counts, only for the columns that can still convert."""
    aggs = []
    for i in indices:
        c = F.col(f"`{cols[i]}`")
        aggs += [F.count_if(_numeric_text(c, variant).isNotNull()).alias(f"cn{i}"),
                 F.count_if(TY.clean_date(c).isNotNull()).alias(f"cd{i}")]
    return aggs


def _detected(st: dict, i: int) -> str:
    nn = st[f"nn{i}"]
    if nn == 0:
        return "unknown"
    if st[f"dn{i}"] > nn * P.INFER_SHARE:
        return "numeric"
    if st[f"dd1{i}"] > nn * P.INFER_SHARE or st[f"dd2{i}"] > nn * P.INFER_SHARE:
        return "date"
    return "text"


def _coercion_stats(df: DataFrame, cols: list[str], variant: str, extra=()) -> dict:
    """Statistics for ``coercion_plan``: detection for all string columns in one pass, then
    conversion counts for the candidate columns only (the cleaner converts only detected
    numeric/date columns, so long text columns never pay for the conversion tests)."""
    aggs = [F.count(F.lit(1)).alias("__rows"), *extra]
    if variant == "cleaner":
        st = df.agg(*aggs, *_detect_aggs(cols)).collect()[0].asDict()
        candidates = [i for i in range(len(cols)) if _detected(st, i) in ("numeric", "date")]
        if candidates:
            st.update(df.agg(*_convert_aggs(cols, candidates, variant)).collect()[0].asDict())
        return st
    return df.agg(*aggs, *_detect_aggs(cols), *_convert_aggs(cols, range(len(cols)), variant)).collect()[0].asDict()


def coercion_plan(df: DataFrame, gate: float = P.COERCE_SHARE, variant: str = "cleaner",
                  stats: dict | None = None) -> list[dict]:
    """Decide conversions for string columns (one or two aggregations, one row each to the driver).

    cleaner (TYP3): detect numeric/date (> 70 % of non-nulls look like it), convert when
    more than ``gate`` of ALL rows convert.  extractor (TYP4): try numeric, then date, same gate.
    ``stats`` may carry the row of an aggregation already run (see ``clean``).
    """
    cols = [f.name for f in df.schema.fields if _is_string(f.dataType)]
    if not cols:
        return []
    st = stats if stats is not None else _coercion_stats(df, cols, variant)
    rows = st["__rows"]
    plan = []
    for i, name in enumerate(cols):
        if variant == "cleaner":
            detected = _detected(st, i)
            candidates = [detected] if detected in ("numeric", "date") else []
        else:
            candidates = ["numeric", "date"]
        for target in candidates:
            ok = st[f"cn{i}"] if target == "numeric" else st[f"cd{i}"]
            rate = ok / rows if rows else 0.0
            if rate > gate:
                plan.append({"column": name, "to": "numeric" if target == "numeric" else "datetime",
                             "success_rate": round(rate * 100, 2)})
                break
    return plan


def apply_coercion(df: DataFrame, plan: list[dict], variant: str = "cleaner") -> DataFrame:
    conv = {p["column"]: p["to"] for p in plan}
    out = []
    for name in df.columns:
        c = F.col(f"`{name}`")
        if conv.get(name) == "numeric":
            out.append(_numeric_text(c, variant).alias(name))
        elif conv.get(name) == "datetime":
            out.append(TY.clean_date(c).alias(name))
        else:
            out.append(c)
    return df.select(*out)


def coerce_columns(df: DataFrame, gate: float = P.COERCE_SHARE, variant: str = "cleaner") -> tuple[DataFrame, DataFrame]:
    """TYP3 (variant cleaner) / TYP4 (variant extractor): (converted frame, report)."""
    plan = coercion_plan(df, gate, variant)
    report = df.sparkSession.createDataFrame(
        [(p["column"], "string", p["to"], float(p["success_rate"])) for p in plan],
        "column string, from_type string, to_type string, success_rate double",
    )
    return apply_coercion(df, plan, variant), report


class CleanResult:
    """Cleaned rows plus report frames; the reports are built on first access only."""

    def __init__(self, original: DataFrame, data: DataFrame, actions: DataFrame, n_actions: int):
        self.original = original
        self.data = data
        self.actions = actions
        self._n_actions = n_actions

    @cached_property
    def anomalies(self) -> DataFrame:
        return PR.anomaly_report(self.data)

    @cached_property
    def integrity(self) -> DataFrame:
        return IN.integrity_report(self.original, self.data, actions=self._n_actions)


def _normalized(df: DataFrame, legacy_space_a_grave: bool, keep_internal: bool) -> tuple[list[str], list[int], DataFrame]:
    """New names, positions of the cleaned columns, and the rows with a ``__ws<i>`` flag for each: white space changed."""
    fields = df.schema.fields
    new_names = normalize_names([f.name for f in fields], keep_internal=keep_internal)
    strings = [i for i, f in enumerate(fields) if _is_string(f.dataType) and not
               (keep_internal and f.name.startswith("_"))]
    # step-wise projections: each step's output is a column the next step reads once
    # (Catalyst keeps projections apart when an expensive alias is read twice)
    step1 = df.select(*[
        (X.fix_mojibake(F.col(f"`{f.name}`"), legacy_space_a_grave=legacy_space_a_grave) if i in strings
         else F.col(f"`{f.name}`")).alias(f"__c{i}") for i, f in enumerate(fields)])
    step2 = step1.select(*[F.col(f"__c{i}") for i in range(len(fields))],
                         *[X.collapse_ws(F.col(f"__c{i}")).alias(f"__w{i}") for i in strings])
    proj = []
    for i in range(len(fields)):
        if i in strings:
            proj.append(X.deep_normalize(F.col(f"__w{i}")).alias(new_names[i]))
            proj.append((~F.col(f"__c{i}").eqNullSafe(F.col(f"__w{i}"))).alias(f"__ws{i}"))
        else:
            proj.append(F.col(f"__c{i}").alias(new_names[i]))
    normalized = step2.select(*proj)
    return new_names, strings, normalized


def clean_rows(df: DataFrame, plan: list[dict] | None = None, variant: str = "cleaner", legacy_space_a_grave: bool = False) -> DataFrame:
    """CAT6 row by row: TXT1 -> TXT2 -> PRJ1 -> TXT7, then the conversions of ``plan`` (from ``coercion_plan``).

    What it gives a row does not depend on other rows, so a stream's batches and one batch of all rows agree.
    """
    out = _normalized(df, legacy_space_a_grave, True)[2]
    out = out.select(*[c for c in out.columns if not c.startswith("__ws")])
    return apply_coercion(out, plan, variant) if plan else out


def clean(df: DataFrame, strict: bool = True, materialize: bool = True, legacy_space_a_grave: bool = False,
          keep_internal: bool = True) -> CleanResult:
    """CAT6: TXT1 -> TXT2 -> PRJ1 -> TXT7 -> TYP3 -> AGG1 -> AGG9 -> AGG10.

    Returns the cleaned rows plus three report frames (actions, anomalies, integrity).
    ``strict`` raises when rows or columns were lost.
    """
    spark = df.sparkSession
    fields = df.schema.fields
    # rows are counted while the one write reads them
    seen = Observation()
    source = df.observe(seen, F.count(F.lit(1)).alias("rows")) if materialize else df
    new_names, strings, normalized = _normalized(source, legacy_space_a_grave, keep_internal)
    if materialize:
        normalized = materialize_table(normalized, "clean")
    body_cols = [c for c in normalized.columns if not c.startswith("__ws")]
    string_names = [f.name for f in normalized.schema.fields if f.name in body_cols and _is_string(f.dataType)]
    # one aggregation: whitespace change counts + every conversion statistic (one row to the driver)
    st = _coercion_stats(normalized, string_names, "cleaner",
                         extra=[F.count_if(F.col(f"__ws{i}")).alias(f"w{i}") for i in strings])
    ws_counts = {f"w{i}": st[f"w{i}"] for i in strings}
    body = normalized.select(*body_cols)
    plan = coercion_plan(body, variant="cleaner", stats=st)
    cleaned = apply_coercion(body, plan, "cleaner")

    actions = []
    for i in strings:
        actions.append(("fix_encoding", new_names[i], None, None))
    for i in strings:
        if ws_counts.get(f"w{i}", 0) > 0:
            actions.append(("trim", fields[i].name, int(ws_counts[f"w{i}"]), None))
    actions.append(("normalize", "column_names", None, None))
    for i in strings:
        actions.append(("normalize_vn_text", new_names[i], None, None))
    for p in plan:
        actions.append(("type_convert", p["column"], None, float(p["success_rate"])))
    actions_df = spark.createDataFrame(
        actions, "action string, column string, rows_affected bigint, success_rate double")
    if strict:
        # what strict mode guards; the full report with fingerprints stays lazy in ``integrity``
        before = seen.get["rows"] if materialize else df.count()
        if st["__rows"] < before or len(cleaned.columns) < len(df.columns):
            raise ValueError("data loss detected during cleaning")
    return CleanResult(df, cleaned, actions_df, len(actions))

"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints ONE JSON line.

Each query is executed to completion with a ``noop`` write (every row is
computed, nothing is collected to the driver), once to warm up and then
$BENCH_REPS times; the median is reported.  The DuckDB twin of each query is
timed on the same Parquet files for reference (``duckdb_queries``).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "quality_scorecard_dirty_customer",
    "quality_columns_dirty_orders",
    "gold_tables_documents",
    "provenance_documents",
    "duplicate_content_documents",
    "keyword_search_documents",
    "text_repair_documents",
    "vietnamese_normalize_documents",
    "extract_entities_documents",
    "clean_documents",
    "monthly_usage_users",
    "quota_check_users",
    "classify_intent_questions",
    "pack_context_by_source",
    "sql_hash_aggregate_lineitem",
    "sql_ranking_windows",
    "asof_join_purchase_last_view",
    "coerce_columns_dirty_orders",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    with_duck = os.environ.get("BENCH_DUCKDB", "1") == "1"

    from silverline.plans.fixtures import BASE_TABLES
    from silverline.plans.registry import load_all
    from silverline.session import get_spark

    spark = get_spark(f"local[{cpus}]", cpus)
    queries = load_all()
    names = only or HEADLINE
    spark_times: dict[str, float] = {}
    duck_times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in names:
        q = queries[name]
        runs = []
        try:
            for i in range(reps + 1):
                t0 = time.perf_counter()
                q.fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
                if i:
                    runs.append(time.perf_counter() - t0)
            spark_times[name] = round(statistics.median(runs), 3)
        except Exception as e:  # noqa: BLE001 - one failing query must not hide the others' timings
            errors[name] = f"{type(e).__name__}: {str(e)[:300]}"
    if with_duck:
        import duckdb

        con = duckdb.connect()
        con.execute(f"set threads = {cpus}")
        for t in BASE_TABLES:
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
        for name in names:
            sql = queries[name].sql
            if sql is None:
                continue
            runs = []
            try:
                for i in range(reps + 1):
                    t0 = time.perf_counter()
                    # hash every output column so DuckDB cannot prune computed expressions
                    con.execute(f"select count(*), sum(hash(__q)) from ({sql}) __q").fetchall()
                    if i:
                        runs.append(time.perf_counter() - t0)
                duck_times[name] = round(statistics.median(runs), 3)
            except Exception as e:  # noqa: BLE001
                errors[f"duckdb:{name}"] = f"{type(e).__name__}: {str(e)[:300]}"
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    total = round(sum(spark_times.values()), 3)
    print(json.dumps({
        "metric": "headline_total_sec",
        "value": total,
        "unit": "sec",
        "queries": spark_times,
        "sf": sf.group(1) if sf else sf_dir,
        "cpus": cpus,
        "reps": reps,
        "duckdb_queries": duck_times,
        "duckdb_total_sec": round(sum(duck_times.values()), 3),
        **({"errors": errors} if errors else {}),
    }))


if __name__ == "__main__":
    main()

import json
import tempfile

import numpy as np

from silverline.operators import sketches as SK
from silverline.operators.ledger import promote_changed, read_ledger

KIND = "ds string, k int, price string, _note string"


def _run(spark, rows, root, **kw):
    df = spark.createDataFrame(rows, KIND).repartition(3)
    return {(r["dataset_id"], r["action"], r["rows"]) for r in promote_changed(df, "ds", root, **kw).collect()}


def test_only_changed_datasets_are_promoted_again(spark):
    root = tempfile.mkdtemp(prefix="sl-ledger-") + "/gold"
    rows = [("a", 1, "1,000", "x"), ("a", 2, "bad", "x"), ("b/ c=1", 1, "5", None), (None, 1, "7", None), ("", 1, "8", None)]
    everything = {("a", 2), ("b/ c=1", 1), (None, 1), ("", 1)}
    assert _run(spark, rows, root) == {(d, "promoted", n) for d, n in everything}
    assert _run(spark, rows[::-1], root) == {(d, "skipped", n) for d, n in everything}
    assert {r["run"] for r in read_ledger(spark, root).collect()} == {0}  # the second run wrote nothing
    noted = [(*r[:3], "other") for r in rows]  # an internal column does not count
    assert {a for _, a, _ in _run(spark, noted, root)} == {"skipped"}
    changed = [*rows[1:], ("a", 1, "1,001", "x"), ("a", 3, None, None)]
    assert _run(spark, changed, root) == {("a", "promoted", 3), *((d, "skipped", n) for d, n in everything if d != "a")}
    stored = sorted((str(r["ds"]), r["k"], str(r["price"])) for r in spark.read.parquet(f"{root}/tables").collect())
    assert stored == sorted((str(d), k, str(p)) for d, k, p, _ in changed)
    tables = {r["dataset_id"]: r for r in spark.read.parquet(f"{root}/meta/gold_tables").collect()}
    assert set(tables) == {"a", "b/ c=1", None, ""} and tables["a"]["row_count"] == 3
    schema = json.loads(tables["a"]["schema_json"])["columns"]
    assert [c["name"] for c in schema] == ["k", "price"] and schema[1]["nullable"] is True
    columns = spark.read.parquet(f"{root}/meta/gold_columns").collect()
    assert len(columns) == 8 and {c["gold_table_id"] for c in columns} == {t["id"] for t in tables.values()}
    assert {a for _, a, _ in _run(spark, changed, root, force=True)} == {"promoted"}
    assert spark.read.parquet(f"{root}/tables").count() == len(changed) and read_ledger(spark, root).agg({"run": "max"}).first()[0] == 2


def test_sketches_merge_within_the_bound(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else None, int(i % 7), float(v)) for i, v in enumerate(rng.lognormal(3, 1, 9000))] + [("few", 0, v) for v in (1.0, 2.0, 3.0)] + [("few", 1, None)]
    df = spark.createDataFrame(rows, "key string, day int, v double").repartition(5)
    wanted = {"p50": 0.5, "p95": 0.95}
    merged = SK.merge_sketches(SK.quantile_sketches(df, ["key", "day"], "v"), ["key"])
    found = SK.quantiles(merged, wanted)
    exact = {r["key"]: r for r in found.collect()}
    assert exact["few"]["n"] == 3 and exact["few"]["p50"] == 2.0 and exact["few"]["p95"] == 3.0
    errors = SK.rank_errors(df, ["key"], "v", found, wanted).collect()
    assert {r["key"] for r in errors} == {"hot", None, "few"} and all(r[c] <= SK.RANK_ERROR for r in errors for c in wanted)
    wrong = SK.rank_errors(df, ["key"], "v", found.withColumn("p50", found["p95"]), wanted).where("key = 'hot'").first()
    assert wrong["p50"] > 0.4  # the measure can fail

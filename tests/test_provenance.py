"""Skew-safe row numbering vs a brute-force window, with one dataset holding a third of the rows."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from silverline.operators.provenance import number_rows


def test_number_rows_matches_window_on_skewed_data(spark):
    rows = [("hot", i) for i in range(3000)] + [(f"d{i % 50}", i) for i in range(6000)]
    df = spark.createDataFrame(rows, "ds string, k bigint").repartition(7)
    got = number_rows(df, ["ds"], ["k"], num_partitions=16)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("ds").orderBy("k")))
    diff = got.join(want, ["ds", "k"]).where(F.col("_row_number") != F.col("rn")).count()
    assert got.count() == 9000 and diff == 0


def test_hot_dataset_spans_many_partitions(spark):
    rows = [("hot", i) for i in range(3000)] + [(f"d{i % 50}", i) for i in range(6000)]
    df = spark.createDataFrame(rows, "ds string, k bigint")
    ranged = df.repartitionByRange(16, "ds", "k").withColumn("p", F.spark_partition_id())
    assert ranged.where(F.col("ds") == "hot").select("p").distinct().count() > 3


def test_attach_per_key_salted_path_matches_broadcast(spark):
    from silverline.operators.joins import attach_per_key

    rows = spark.createDataFrame([("hot", i) for i in range(3000)] + [(f"k{i % 40}", i) for i in range(2000)],
                                 "g string, v bigint")
    per_key = rows.groupBy("g").count()
    a = attach_per_key(rows, per_key, ["g"])                        # adaptive path
    b = attach_per_key(rows, per_key, ["g"], salt_buckets=32)       # salted path
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert b.count() == 5000 and "hashpartitioning(g" in plan and "__salt" in plan


def test_null_groups_are_kept(spark):
    from silverline.operators.joins import attach_per_key

    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "ds string, k bigint")
    got = sorted(((r["ds"] or ""), r["k"], r["_row_number"]) for r in number_rows(df, ["ds"], ["k"]).collect())
    assert got == [("", 1, 1), ("", 2, 2), ("a", 1, 1)]
    counts = df.groupBy("ds").count()
    for salts in (None, 4):
        out = attach_per_key(df, counts, ["ds"], how="inner", salt_buckets=salts)
        assert sorted(((r["ds"] or ""), r["count"]) for r in out.collect()) == [("", 2), ("", 2), ("a", 1)]


def test_what_makes_the_rows_runs_once(spark):
    """A range exchange computes its input twice, for its bounds and for its rows."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    df = spark.range(0, 500, 1, 4).selectExpr("id % 3 as ds", "500 - id as k").mapInPandas(count, "ds long, k long")
    got = sorted((r["ds"], r["k"], r["_row_number"]) for r in number_rows(df, ["ds"], ["k"]).collect())
    want = [(d, k, i + 1) for d in range(3) for i, k in enumerate(sorted(500 - j for j in range(500) if j % 3 == d))]
    assert got == want and made.value == 500

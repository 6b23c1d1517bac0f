from pyspark.sql import functions as F

from silverline.operators import integrity as IN


def test_fingerprint_ignores_order_and_partitioning(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 7).cast("string").alias("s"))
    a = IN.table_fingerprint(df).first()["fingerprint"]
    b = IN.table_fingerprint(df.repartition(13).orderBy(F.rand(1))).first()["fingerprint"]
    c = IN.table_fingerprint(df.where("id > 0")).first()["fingerprint"]
    assert a == b and a != c
    x = IN.table_fingerprint(df, method="xxhash64").first()["fingerprint"]
    y = IN.table_fingerprint(df.repartition(7).orderBy(F.rand(2)), method="xxhash64").first()["fingerprint"]
    dup = IN.table_fingerprint(df.unionByName(df.limit(1)), method="xxhash64").first()["fingerprint"]
    assert x == y and x != dup


def test_change_counts_null_safe(spark):
    df = spark.createDataFrame([("a", "a"), (None, None), ("b", "c"), (None, "x")], "b string, a string")
    r = IN.change_counts(df, [("col", "b", "a")], "trim").first()
    assert r["rows_affected"] == 2


def test_data_loss_and_verify(spark):
    before = spark.range(10).withColumn("x", F.lit(1))
    after = before.where("id < 8")
    r = IN.data_loss_check(before, after).first()
    assert r["data_loss"] is True and r["errors"] == ["Row count decreased: 10 -> 8 (2 lost)"]
    v = IN.verify_extraction(before, after, "tabular").first()
    assert v["verified"] is False and v["accuracy"] == 80.0

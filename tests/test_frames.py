"""Range frames by buckets with a halo, against the plain window."""

import random

import pytest
from pyspark.sql import functions as F

from silverline.operators.frames import range_frame

AGGS = {"n": ("count", "x"), "total": ("sum", "x"), "low": ("min", "x"), "high": ("max", "x")}


def plain(df, preceding):
    over = f"over (partition by k order by v range between {preceding}{'D' * isinstance(preceding, float)} preceding and current row)"
    return df.select("*", *(F.expr(f"{how}({c}) {over}").alias(n) for n, (how, c) in AGGS.items()))


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize(("kind", "preceding", "width"), [("double", 10.0, None), ("double", 0.3, 0.1), ("double", 2.5, 7.0), ("bigint", 7, None),
                                                         ("bigint", 7, 2), ("bigint", 0, 5)])
def test_equal_to_the_window_over_whole_keys(spark, kind, preceding, width):
    rng = random.Random(int(preceding * 10))
    odd = [None, float("nan"), float("inf"), float("-inf"), -0.1, 0.0] if kind == "double" else [None, 0, -7, -8]
    values = [round(rng.uniform(-20, 60), 1) if kind == "double" else rng.randint(-20, 60) for _ in range(500)] + odd * 2
    keys = ["hot"] * 400 + ["a", "b", None] * 200
    data = [(k, v, rng.choice([None, *range(9)]), i) for i, (k, v) in enumerate(zip(keys, values, strict=False))]
    df = spark.createDataFrame(data, f"k string, v {kind}, x bigint, id bigint").repartition(5)
    assert rows(range_frame(df, ["k"], "v", preceding, AGGS, width)) == rows(plain(df, preceding))


def test_defined_cases(spark):
    df = spark.createDataFrame([("a", 1.0, 2, "x")], "k string, v double, x bigint, `__n` string")
    assert range_frame(df.limit(0), ["k"], "v", 1.0, AGGS).count() == 0
    out = range_frame(df, ["k"], "v", 1.0, AGGS)
    assert out.columns == [*df.columns, *AGGS] and out.first()["total"] == 2
    assert range_frame(df, [], "v", 1.0, {"n": ("count", "x")}).first()["n"] == 1
    with pytest.raises(ValueError):
        range_frame(df, ["k"], "v", 1.0, {"X": ("count", "x")})
    with pytest.raises(ValueError):
        range_frame(df, ["k"], "v", 0.0, AGGS)


@pytest.mark.parametrize(("kind", "preceding"), [("double", 10.0), ("float", 3.0), ("bigint", 1), ("bigint", 9), ("decimal(20,2)", 2.5)])
def test_equal_to_the_window_at_the_ends_of_the_type(spark, kind, preceding):
    rng = random.Random(3)
    top = {"double": 2.0**55, "float": 2.0**24, "bigint": float(2**62), "decimal(20,2)": 1e17}[kind]
    values = [s * (top / 2**k + rng.randint(-20, 20)) for k in range(8) for s in (1, -1) for _ in range(25)]
    data = [(rng.choice("ab"), str(int(v)), rng.choice([None, 1, 2]), i) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "k string, v string, x bigint, id bigint").withColumn("v", F.col("v").cast(kind))
    step = preceding if kind != "decimal(20,2)" else "cast(2.5 as decimal(20,2))"
    assert rows(range_frame(df, ["k"], "v", preceding, AGGS)) == rows(plain(df, step))


def test_sums_keep_their_type_and_rows_are_counted(spark):
    df = spark.createDataFrame([("a", i % 7, i) for i in range(50)], "k string, v int, x int").withColumn("x", F.expr("if(x % 3 = 0, null, cast(x as decimal(9,2)))"))
    want = spark.sql(
        "select *, count(*) over w as n, sum(x) over w as s from {df} window w as (partition by k order by v range between 3 preceding and current row)", df=df)
    got = range_frame(df, ["k"], "v", 3, {"n": ("count", "*"), "s": ("sum", "x")})
    assert rows(got) == rows(want) and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]


def test_work_does_not_grow_with_the_rows_of_a_frame(spark):
    """Each frame holds a third of 200,000 values: walking them takes minutes."""
    import time

    df = spark.range(200_000).select(F.lit("a").alias("k"), (F.col("id") * 0.5).alias("v"), F.col("id").alias("x"))
    began = time.time()
    out = range_frame(df, ["k"], "v", 33_333.0, AGGS).where("v = 90000").first()
    assert time.time() - began < 60
    assert (out["n"], out["low"], out["high"], out["total"]) == (66_667, 113_334, 180_000, sum(range(113_334, 180_001)))


def test_sql_frames_walks_no_frame_of_a_status(spark, sf):
    from silverline.plans.registry import load_all

    got = load_all()["sql_frames"].fn(spark, sf)
    assert "windowspecdefinition(o_orderstatus" not in got._jdf.queryExecution().optimizedPlan().toString()
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    want = spark.sql("select o_orderkey, count(*) over (partition by o_orderstatus order by o_totalprice range between 1000 preceding and current row) as price_band from {o}", o=orders)
    assert rows(got.select("o_orderkey", "price_band")) == rows(want)

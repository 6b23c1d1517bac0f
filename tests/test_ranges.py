import datetime as dt
import math
import random

import pytest

from silverline.operators.ranges import range_aggregate, range_join


@pytest.mark.parametrize("closed", ["both", "left"])
def test_range_join_matches_a_nested_loop(spark, closed):
    rnd = random.Random(4)
    points = [(i, rnd.choice([rnd.uniform(-50, 50), float(rnd.randint(-5, 5)), 7.0])) for i in range(300)]
    points += [(300, None), (301, math.nan), (302, -1e9), (303, 7.0), (303, 7.0)]
    spans = [(i, a, a + rnd.choice([0, 1e-9, 0.5, 3, 40, 1e6])) for i, a in enumerate(rnd.choice([rnd.uniform(-60, 60), 7.0, -5.0]) for _ in range(150))]
    spans += [(200, None, 3.0), (201, 1.0, None), (202, 5.0, 4.0), (203, -math.inf, math.inf), (204, 7.0, 7.0), (205, -math.inf, 0.0), (206, math.nan, 1.0), (207, 7.0, 7.0),
              (208, 1e12, 1e13)]
    got = range_join(spark.createDataFrame(points, "k int, p double"), spark.createDataFrame(spans, "s int, a double, b double"), "p", "a", "b", closed)
    want = sorted((k, s) for k, p in points for s, a, b in spans
                  if None not in (p, a, b) and not any(map(math.isnan, (p, a, b))) and a <= p and (p <= b if closed == "both" else p < b))
    assert sorted((r["k"], r["s"]) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_range_join_of_dates_empty_sides_and_single_values(spark):
    day = dt.date(2024, 1, 1)
    points = spark.createDataFrame([(i, day + dt.timedelta(days=i)) for i in range(10)], "k int, p date")
    spans = spark.createDataFrame([(1, day, day), (2, day + dt.timedelta(days=3), day + dt.timedelta(days=5)), (3, dt.date(1900, 1, 1), dt.date(2100, 1, 1))], "s int, a date, b date")
    got = sorted((r["k"], r["s"]) for r in range_join(points, spans, "p", "a", "b").collect())
    assert got == sorted([(0, 1), (3, 2), (4, 2), (5, 2), *((i, 3) for i in range(10))])
    assert range_join(points.limit(0), spans, "p", "a", "b").count() == 0 == range_join(points, spans.limit(0), "p", "a", "b").count()
    one = range_join(points.where("k = 4"), spans.where("s = 2"), "p", "a", "b").collect()
    assert [(r["k"], r["s"]) for r in one] == [(4, 2)]


def test_an_interval_takes_few_buckets_whatever_its_length(spark):
    points = spark.range(1000).selectExpr("id as k", "cast(id as double) as p")
    spans = spark.createDataFrame([(i, 0.0, 10.0 ** (i % 9 - 4)) for i in range(90)], "s int, a double, b double")
    joined = range_join(points, spans, "p", "a", "b", salts=1)
    assert joined.count() == sum(sum(1 for p in range(1000) if p <= 10.0 ** (i % 9 - 4)) for i in range(90))


AGGS = {"n": ("count", "*"), "some": ("count", "x"), "total": ("sum", "x"), "least": ("min", "k"), "most": ("max", "p")}


@pytest.mark.parametrize("closed", ["both", "left"])
def test_range_aggregate_equals_aggregates_of_the_pairs(spark, closed):
    rnd = random.Random(9)
    points = [(i, rnd.choice([rnd.uniform(-50, 50), float(rnd.randint(-5, 5)), 7.0, -0.0]), rnd.choice([None, 1, 5])) for i in range(400)]
    points += [(400, None, 1), (401, math.nan, 1), (402, -1e9, 1), (403, math.inf, 1), (404, -math.inf, 1)]
    spans = [(i, a, a + rnd.choice([0, 1e-9, 0.5, 3, 40, 1e6])) for i, a in enumerate(rnd.choice([rnd.uniform(-60, 60), 7.0, -5.0, 0.0]) for _ in range(200))]
    spans += [(200, None, 3.0), (201, 1.0, None), (202, 5.0, 4.0), (203, -math.inf, math.inf), (204, 7.0, 7.0), (204, 7.0, 7.0), (206, math.nan, 1.0), (208, 1e12, 1e13)]
    p, s = spark.createDataFrame(points, "k int, p double, x long"), spark.createDataFrame(spans, "s int, a double, b double")
    got = range_aggregate(p, s, "p", "a", "b", AGGS, closed)
    assert got.columns == [*s.columns, *AGGS]

    def held(a, b):
        return [r for r in points if r[1] is not None and not math.isnan(r[1]) and a <= r[1] and (r[1] <= b if closed == "both" else r[1] < b)]

    def row(i, rs):
        xs = [x for *_, x in rs if x is not None]
        return (i, len(rs), len(xs), sum(xs) if xs else None, min(r[0] for r in rs), max(r[1] for r in rs))

    want = [row(i, held(a, b)) for i, a, b in spans if a is not None and b is not None and held(a, b)]
    assert sorted(map(str, want)) == sorted(str((r["s"], *[r[n] for n in AGGS])) for r in got.collect())
    assert range_aggregate(p.limit(0), s, "p", "a", "b", AGGS).count() == 0 == range_aggregate(p, s.limit(0), "p", "a", "b", AGGS).count()


def test_no_pairs_are_made(spark):
    """A thousand million pairs: 20,000 intervals that hold half of 100,000 points each."""
    import time

    points = spark.range(100_000).selectExpr("id as k", "cast(id as double) as p")
    spans = spark.range(20_000).selectExpr("id as s", "cast(id as double) as a", "cast(id + 50000 as double) as b")
    began = time.time()
    out = range_aggregate(points, spans, "p", "a", "b", {"n": ("count", "*"), "total": ("sum", "k")}).selectExpr("sum(n) as n", "sum(total) as t").first()
    assert time.time() - began < 60
    assert (out["n"], out["t"]) == (20_000 * 50_001, sum(50_001 * (s + 25_000) for s in range(20_000)))


@pytest.mark.parametrize("name", ["range_join_price_bands", "range_join_order_periods"])
def test_range_queries_join_no_rows_of_orders(spark, sf, name):
    from silverline.plans.registry import load_all

    plan = load_all()[name].fn(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_totalprice <= high" not in plan and "(o_orderdate" not in plan and "__salt" not in plan

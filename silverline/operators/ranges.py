"""DJN4: joins of points with the intervals that hold them, without an equality.

Intervals are put into levels by length: the buckets of level ``i`` are ``base * STEP^i`` wide, and an
interval goes to the two buckets (three at a rounding edge) of the first level at least as wide as it is.  A point
has one bucket in each level that occurs.  So both sides meet on (level, bucket, salt), an ordinary equi-join that Spark
sorts, spreads and splits where it is skewed, and the exact test runs on the few pairs that share a bucket.
Long intervals cost no more rows than short ones.  Points of one hot range are dealt over ``salts`` keys,
for which each interval is copied.

``range_aggregate`` gives aggregates of each interval's points without making the pairs, whose number is a product of both sides.
Distinct points are numbered in order; an interval is then a range of numbers, which is cut into whole blocks of ``STEP^i``
numbers, few of each level; blocks are aggregated once and looked up.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from silverline.operators.frames import MERGE, first_parts
from silverline.session import materialize

STEP = 4
#: levels at most; shorter intervals share the first one
LEVELS = 24
SALTS = 4
_KEYS = ["__level", "__bucket", "__salt"]


def _number(column, kind: str):
    """A number in the order of the column: dates and times by their seconds."""
    if kind.startswith(("date", "timestamp")):
        return F.unix_micros(column.cast("timestamp")).cast("double") / 1e6
    return column.cast("double")


def range_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, closed: str = "both", salts: int = SALTS,
               aggs: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Pairs of rows with ``low <= point <= high`` (``closed="left"``: ``low <= point < high``): all columns of both sides.
    With ``aggs``, the intervals with aggregates of their points, made without the pairs: see ``range_aggregate``.

    Names must differ between the sides.  Null and NaN points or bounds pair with nothing; bounds may be
    infinite; repeated rows give repeated pairs; an empty side gives no rows.  ``point`` and the bounds are of one kind: numbers, or
    dates and times.  Two small aggregations come first (the points' extent; the intervals' lengths), of which single rows reach the driver.
    """
    if closed not in ("both", "left"):
        raise ValueError("closed is 'both' or 'left'")
    if aggs is not None:
        return range_aggregate(points, intervals, point, low, high, aggs, closed)
    kinds = dict(points.dtypes) | dict(intervals.dtypes)
    at, lo, hi = (_number(F.col(c), kinds[c]) for c in (point, low, high))
    left = points.withColumn("__at", at).where(F.col("__at").isNotNull() & ~F.isnan("__at"))
    extent = left.agg(F.min("__at").alias("a"), F.max("__at").alias("b")).first()
    if extent["a"] is None:
        extent = {"a": 0.0, "b": -1.0}
    least, most = (min(max(extent[x], -1e300), 1e300) for x in ("a", "b"))
    # what lies beyond the points needs no buckets
    right = intervals.withColumn("__lo", F.greatest(lo, F.lit(least))).withColumn("__hi", F.least(hi, F.lit(most)))
    right = right.where(lo.isNotNull() & hi.isNotNull() & ~F.isnan(lo) & ~F.isnan(hi) & (F.col("__lo") <= F.col("__hi")))
    length = F.col("__hi") - F.col("__lo")
    sizes = right.where(length > 0).agg(F.min(length).alias("a"), F.max(length).alias("b")).first()
    base = 1.0 if sizes["a"] is None else max(sizes["a"], sizes["b"] / float(STEP) ** (LEVELS - 1))
    base = max(base, max(abs(least), abs(most)) * 2.0**-50)  # bucket numbers stay exact
    top = 0 if sizes["a"] is None else min(LEVELS - 1, max(0, math.ceil(math.log(sizes["b"] / base, STEP))))
    level = F.greatest(F.lit(0), F.least(F.lit(top), F.ceil(F.log(float(STEP), F.greatest(length, F.lit(base)) / base)))).cast("int")
    width = F.lit(base) * F.pow(F.lit(float(STEP)), F.col("__level"))
    right = right.withColumn("__level", level)
    used = sorted(r["__level"] for r in right.select("__level").distinct().collect())  # LEVELS rows at most
    salted = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    right = (right.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("__lo") / width), F.floor(F.col("__hi") / width))))
             .withColumn("__salt", salted).drop("__lo", "__hi"))
    left = (left.withColumn("__salt", F.pmod(F.xxhash64(*points.columns), F.lit(salts)).cast("int"))
            .withColumn("__level", F.explode(F.array(*[F.lit(i) for i in used]).cast("array<int>")))
            .withColumn("__bucket", F.floor(F.col("__at") / width)).drop("__at"))
    p, a, b = F.col(point), F.col(low), F.col(high)
    inside = (p >= a) & ((p <= b) if closed == "both" else (p < b))
    return left.join(right, _KEYS).where(inside).drop(*_KEYS)


def _ranks(cells: DataFrame, spans: DataFrame, closed: str) -> tuple[DataFrame, DataFrame]:
    """``cells`` (__at) with ``__rank``, their place in order, and ``spans`` (__low, __high) with ``__from`` and ``__to``, the places from and before which their cells lie."""
    none = [F.lit(None).cast(spans.schema[c].dataType).alias(c) for c in ("__low", "__high")]
    parts = [c for c in cells.columns if c != "__at"]
    blank = [F.lit(None).cast(cells.schema[c].dataType).alias(c) for c in parts]
    # at one value: a beginning, the cell, an end that includes it
    ends = [spans.select(F.col(c).alias("__at"), F.lit(k).alias("__kind"), F.lit(c == "__high").alias("__ends"), "__low", "__high", *blank)
            for c, k in (("__low", 0), ("__high", 2 if closed == "both" else 0))]
    events = cells.select("__at", F.lit(1).alias("__kind"), F.lit(False).alias("__ends"), *none, *parts)
    for e in ends:
        events = events.unionByName(e)
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once: another range exchange could draw other bounds
    events = materialize(events.repartitionByRange(n, "__at", "__kind").withColumn("__slice", F.spark_partition_id()), "ranges")
    sizes = events.groupBy("__slice").agg(F.count_if(F.col("__kind") == 1).alias("__n"))  # a row a slice
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = F.broadcast(sizes.select("__slice", before.alias("__before")))
    inside = Window.partitionBy("__slice").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = events.withColumn("__seen", F.count_if(F.col("__kind") == 1).over(inside)).join(sizes, "__slice").withColumn("__seen", F.col("__seen") + F.col("__before"))
    ranked = materialize(ranked.drop("__slice", "__before"), "ranks")
    of_spans = ranked.where("__kind <> 1").groupBy("__low", "__high").agg(
        F.max(F.when(~F.col("__ends"), F.col("__seen"))).alias("__from"), F.max(F.when(F.col("__ends"), F.col("__seen"))).alias("__to"))
    return ranked.where("__kind = 1").select((F.col("__seen") - 1).alias("__rank"), *parts), of_spans


def range_aggregate(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, aggs: dict[str, tuple[str, str]], closed: str = "both") -> DataFrame:
    """``intervals`` with ``aggs`` (new column: (count, sum, min or max, column of ``points``; ``*`` counts rows)) over the points that
    ``range_join`` would pair with them; intervals without a point are left out.

    Same rules for nulls, NaN, infinite bounds and kinds.  Values are only compared, never put into buckets by arithmetic.  The work
    grows with points and intervals, each times the logarithm of the points, not with the pairs.
    """
    if closed not in ("both", "left"):
        raise ValueError("closed is 'both' or 'left'")
    if clash := {n.lower() for n in aggs} & {c.lower() for c in intervals.columns}:
        raise ValueError(f"columns exist already: {sorted(clash)}")

    def known(df, c):
        return F.col(c).isNotNull() & ~F.isnan(F.col(c)) if dict(df.dtypes)[c] in ("double", "float") else F.col(c).isNotNull()

    cells = points.where(known(points, point)).groupBy(F.col(point).alias("__at")).agg(*first_parts(aggs))
    parts = [f"__a{i}" for i in range(len(aggs))]
    kinds = {p: cells.schema[p].dataType for p in parts}
    merged = [MERGE[how][1](F.col(p)).cast(kinds[p]).alias(n) for p, (n, (how, _)) in zip(parts, aggs.items(), strict=True)]
    again = [m.alias(p) for m, p in zip(merged, parts, strict=True)]
    ordered = F.col("__low") <= F.col("__high") if closed == "both" else F.col("__low") < F.col("__high")
    spans = intervals.where(known(intervals, low) & known(intervals, high)).select(F.col(low).alias("__low"), F.col(high).alias("__high")).where(ordered).distinct()
    cells, spans = _ranks(cells, spans, closed)
    most = spans.agg(F.max(F.col("__to") - F.col("__from"))).first()[0] or 0
    top = 0  # no block is larger than the longest range
    while STEP ** (top + 1) <= most:
        top += 1
    if top:
        level = F.explode(F.sequence(F.lit(1), F.lit(top)))
        above = cells.withColumn("__level", level).withColumn("__block", F.expr(f"__rank div cast(pow({STEP}, __level) as bigint)"))
        above = above.groupBy("__level", "__block").agg(*again)
        blocks = cells.select(F.lit(0).alias("__level"), F.col("__rank").alias("__block"), *parts).unionByName(above)
    else:
        blocks = cells.select(F.lit(0).alias("__level"), F.col("__rank").alias("__block"), *parts)
    pieces = []
    for i in range(top + 1):
        # of level i: what lies before and after the whole blocks of the next level, or all if it has none
        begin, end = f"((__from + {STEP**i - 1}L) div {STEP**i}L)", f"(__to div {STEP**i}L)"
        inner, outer = f"((__from + {STEP**(i + 1) - 1}L) div {STEP**(i + 1)}L)", f"(__to div {STEP**(i + 1)}L)"
        def run(a, b, i=i):
            return f"if({a} < {b}, transform(sequence({a}, greatest({a}, {b} - 1L)), b -> struct({i} as l, b as b)), array())"
        alone = f"({inner} > {outer})" if i < top else "true"
        pieces.append(f"if({alone}, {run(begin, end)}, concat({run(begin, inner + f' * {STEP}L')}, {run(outer + f' * {STEP}L', end)}))")
    asked = spans.where("__from < __to").select("__low", "__high", F.explode(F.expr(f"concat({', '.join(pieces)})")).alias("__p")).select(
        "__low", "__high", F.col("__p.l").alias("__level"), F.col("__p.b").alias("__block"))
    found = asked.join(blocks, ["__level", "__block"]).groupBy("__low", "__high").agg(*merged)
    return intervals.join(found, (F.col(low) == F.col("__low")) & (F.col(high) == F.col("__high"))).drop("__low", "__high")

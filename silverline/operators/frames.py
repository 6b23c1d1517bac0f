"""Range frames on hot partitions (DWN3): value buckets, two lookups a value.

``agg(x) OVER (PARTITION BY keys ORDER BY v RANGE BETWEEN p PRECEDING AND CURRENT ROW)``
puts a whole key into one task and walks the whole frame for every row.  ``range_frame`` merges rows of equal value
first and cuts the values of a key into buckets of at most half of ``p``.  A frame is then the end of the bucket it begins in,
whole buckets, and the beginning of its value's own bucket.  Running aggregates over each bucket from both ends give these
parts: the frame's value asks its own bucket for the rows up to it, and each bucket before for the rows from ``v - p`` on.
So the work grows with the rows, however many a frame holds, and a key that holds a third of all rows is as many windows
as its values fill buckets.  Parts are merged, never subtracted, so sums, counts, minima and maxima are those of the frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: how partial results of one value are made, and merged over a frame
MERGE = {"count": (F.count, F.sum), "sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}


def first_parts(aggs: dict[str, tuple[str, str]]) -> list[Column]:
    """Partial results ``__a0``, ``__a1``, ... of ``aggs`` (new column: (count, sum, min or max, column); ``*`` counts rows)."""
    return [MERGE[how][0](F.lit(1) if c == "*" else F.col(f"`{c}`")).alias(f"__a{i}") for i, (how, c) in enumerate(aggs.values())]


def _bucket(value: Column, width: float, slack: float | None = None) -> Column:
    at = value / F.lit(width)
    return F.floor(at if slack is None else at + F.abs(at) * slack + 1e-9).cast("bigint")


def _whole_bucket(name: str, width: int) -> Column:
    """The same of a column of whole numbers, exactly."""
    return F.expr(f"{name} div {width}L - if({name} % {width}L < 0, 1L, 0L)")


def _frames_of_few(cells: DataFrame, names: list[str], aggs: dict, step: str, preceding: float, width: float, slack: float) -> DataFrame:
    """Spark's own frames, by buckets with a halo: for values so large that a frame holds few floating-point numbers."""
    value = F.col("__v").cast("double")
    spread = cells.withColumn("__home", _bucket(value, width)).withColumn(
        "__bucket", F.explode(F.sequence("__home", _bucket(value + F.lit(float(preceding)), width, slack))))
    over = f"OVER (PARTITION BY {', '.join([*names, '__bucket'])} ORDER BY __v RANGE BETWEEN {step} PRECEDING AND CURRENT ROW)"
    merged = [F.expr(f"{'sum' if how == 'count' else how}(__a{i}) {over}").alias(f"__a{i}") for i, (how, _) in enumerate(aggs.values())]
    return spread.select(*names, "__v", "__home", "__bucket", *merged).where("__bucket = __home")


def range_frame(df: DataFrame, keys: list[str], order_by: str, preceding: float, aggs: dict[str, tuple[str, str]],
                width: float | None = None) -> DataFrame:
    """``df`` with ``aggs`` (new column: (count, sum, min or max, column)) over rows of its keys from ``preceding`` below its value to its value.

    ``("count", "*")`` counts rows.  ``width`` is the span of a bucket, at most half of ``preceding`` (that if None): a value asks each bucket
    within ``preceding`` below it, so halves of the width double the rows asked for, and the rows of one bucket are sorted by one task.
    Results are those of the SQL frame: rows of equal value share
    one, a null, NaN or infinite value has only its equals in its frame, null keys are a key, an empty table stays empty.
    Columns of ``df`` keep their names and values; ``aggs`` must be new names.
    """
    if clash := {n.lower() for n in aggs} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    if preceding < 0 or float(width or preceding) <= 0:
        raise ValueError("preceding must not be negative, and a width is needed where it is 0")
    by = [F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)] + [F.col(f"`{order_by}`").alias("__v")]
    names, parts = [f"__k{i}" for i in range(len(keys))], [f"__a{i}" for i in range(len(aggs))]
    cells = df.groupBy(*by).agg(*first_parts(aggs))
    kinds = {p: cells.schema[p].dataType for p in parts}
    merged = [MERGE[how][1](F.col(p)).cast(kinds[p]).alias(n) for p, (n, (how, _)) in zip(parts, aggs.items(), strict=True)]
    kind = df.schema[order_by].dataType
    value = F.col("__v").cast("double")
    if whole := isinstance(kind, T.IntegralType):
        step = str(int(preceding))
        span = max(1, min(int(width or preceding), int(preceding) // 2))
        cells = cells.withColumns({"__whole": F.col("__v").cast("bigint"),
                                   "__low": F.coalesce(F.expr(f"try_subtract(cast(__v as bigint), {step}L)"), F.lit(-(1 << 63)))})
        home, begin = _whole_bucket("__whole", span), _whole_bucket("__low", span)
        alone = F.col("__v").isNull()
    else:
        step = f"{float(preceding)!r}D"  # cast to the type of the values, as a frame does
        span = min(float(width or preceding), preceding / 2) or 1.0
        cells = cells.withColumn("__low", F.col("__v") - F.lit(float(preceding)).cast(kind))
        home, begin = _bucket(value, span), _bucket(F.col("__low").cast("double"), span)
        # NaN is the greatest value; numbers that the step does not change
        alone = F.col("__v").isNull() | ~(F.abs(value) < F.lit(float("inf"))) | (F.col("__low") == F.col("__v"))
    if (int(preceding) if whole else preceding) == 0:
        alone = F.lit(True)
    many = cells.where(~alone)
    found = [cells.where(alone).select(*names, "__v", *parts)]
    if not whole:  # buckets hold where numbers are finer than they are: elsewhere frames hold a few numbers only
        bits = 20 if isinstance(kind, T.FloatType) else 49
        limit = span * 2.0**bits
        found.append(_frames_of_few(many.where(F.abs(value) >= limit), names, aggs, step, preceding, span, 2.0 ** -(bits + 2))
                     .where(F.abs(value) >= 2 * limit).select(*names, "__v", *parts))
        many = many.where(F.abs(value) < 4 * limit)
    mine = F.lit(True) if whole else F.abs(value) < 2 * limit
    asked = many.where(mine).select(*names, F.col("__low").alias("__at"), "__v", begin.alias("__begin"), home.alias("__home"))
    asked = asked.withColumn("__bucket", F.explode(F.sequence("__begin", F.col("__home") - 1)))
    asked = asked.select(*names, "__bucket", F.when(F.col("__bucket") == F.col("__begin"), F.col("__at")).alias("__at"), "__v", F.lit(1).alias("__asks"),
                         *(F.lit(None).cast(kinds[p]).alias(p) for p in parts))
    events = many.select(*names, home.alias("__bucket"), F.col("__v").alias("__at"), "__v", F.lit(0).alias("__asks"), *parts).unionByName(asked)
    bucket = Window.partitionBy(*names, "__bucket")
    rows = (Window.unboundedPreceding, Window.currentRow)
    up = bucket.orderBy(F.col("__asks"), F.col("__at")).rowsBetween(*rows)
    # from the bucket's end; what is asked at a value comes after it, what is asked of a whole bucket (null) last
    down = bucket.orderBy(F.col("__at").desc_nulls_last(), F.col("__asks")).rowsBetween(*rows)
    run = [F.when(F.col("__asks") == 0, MERGE[how][1](p).over(up)).otherwise(MERGE[how][1](p).over(down)).cast(kinds[p]).alias(p)
           for p, (how, _) in zip(parts, aggs.values(), strict=True)]
    near = events.select(*names, "__v", *run)
    found.append(near if whole else near.where(mine))
    framed = found[0]
    for other in found[1:]:
        framed = framed.unionByName(other)
    framed = framed.groupBy(*names, "__v").agg(*merged)
    same = F.col(f"`{order_by}`").eqNullSafe(F.col("__v"))
    for k, n in zip(keys, names, strict=True):
        same &= F.col(f"`{k}`").eqNullSafe(F.col(n))
    return df.join(framed, same).select(*(F.col(f"`{c}`") for c in df.columns), *aggs)

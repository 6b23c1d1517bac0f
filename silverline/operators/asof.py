"""As-of join (DJN5): each left row gets the latest right row with the same key at or before it.

Spark has no ASOF JOIN.  A plain ``last(ignorenulls)`` window partitioned by
the key would put a hot key (a third of all rows) into one task, so the time
axis is cut into buckets:

1. left and right rows are unioned and tagged; inside each (key, bucket) a
   window ordered by (time, right-before-left) carries the latest right row
   forward - partitions are (key, bucket), so a hot key spreads over buckets;
2. the latest right row of every (key, bucket) is aggregated (partial
   aggregation), and a window over that small per-bucket table carries it into
   later buckets (one row per key and bucket - bounded by the time range);
3. left rows without an in-bucket match take the carried row via an equi-join
   on (key, bucket).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def _bucket(df: DataFrame, col: str, width: float) -> Column:
    dt = df.schema[col].dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        micros = F.unix_micros(F.col(col).cast("timestamp"))
        return F.floor(micros / F.lit(int(width * 1_000_000))).cast("bigint")
    return F.floor(F.col(col) / F.lit(width)).cast("bigint")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str,
              bucket_seconds: float = 86400.0, tiebreak: list[str] | None = None) -> DataFrame:
    """LEFT as-of join: right row with the greatest ``right_on <= left_on`` per ``by`` key.

    Equal right times are broken by ``tiebreak`` columns of ``right`` (default: all of them;
    the largest wins), so the result is deterministic.  Left rows without a match keep nulls.
    """
    # null keys and null times match nothing: the right rows go, the left rows are added again at the end
    usable = [F.col(c).isNotNull() for c in by]
    fine = reduce(and_, [*usable, F.col(left_on).isNotNull()])
    lost, left = left.where(~fine), left.where(fine)
    right = right.where(reduce(and_, [*usable, F.col(right_on).isNotNull()]))
    rcols = [c for c in right.columns if c not in by]
    tb = tiebreak or [c for c in rcols if c != right_on]
    lcols = left.columns

    l_ = left.select(
        *[F.col(c) for c in by], F.col(left_on).alias("__t"), _bucket(left, left_on, bucket_seconds).alias("__b"),
        F.lit(1).alias("__side"), F.struct(*[F.col(c) for c in lcols if c not in by]).alias("__l"),
        F.lit(None).cast(T.StructType([T.StructField(c, right.schema[c].dataType) for c in rcols])).alias("__r"),
    )
    r_ = right.select(
        *[F.col(c) for c in by], F.col(right_on).alias("__t"), _bucket(right, right_on, bucket_seconds).alias("__b"),
        F.lit(0).alias("__side"),
        F.lit(None).cast(T.StructType([T.StructField(c, left.schema[c].dataType) for c in lcols if c not in by]))
        .alias("__l"),
        F.struct(*[F.col(c) for c in rcols]).alias("__r"),
    )
    both = l_.unionByName(r_)
    # equal right times: ascending tie-break, so the last row carried forward is the largest
    # (the same row max_by picks for the per-bucket carry below)
    order = [F.col("__t"), F.col("__side")] + [F.col(f"__r.{c}").asc_nulls_first() for c in tb]
    w = Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = both.withColumn("__m", F.last("__r", ignorenulls=True).over(w)).where(F.col("__side") == 1)

    # latest right row of each (key, bucket), carried into later buckets
    rank_key = F.struct(F.col(right_on), *[F.col(c) for c in tb])
    per_bucket = right.groupBy(*by, _bucket(right, right_on, bucket_seconds).alias("__b")).agg(
        F.max_by(F.struct(*[F.col(c) for c in rcols]), rank_key).alias("__last"))
    need = left.select(*by, _bucket(left, left_on, bucket_seconds).alias("__b")).distinct()
    buckets = need.join(per_bucket, [*by, "__b"], "full")
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = buckets.withColumn("__carry", F.last("__last", ignorenulls=True).over(before)).select(
        *by, "__b", "__carry")

    out = matched.join(carry, [*by, "__b"], "left")
    m = F.coalesce(F.col("__m"), F.col("__carry"))
    found = out.select(
        *[F.col(c) if c in by else F.col(f"__l.{c}").alias(c) for c in lcols],
        *[m[c].alias(c) for c in rcols],
    )
    return found.union(lost.select(*lcols, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in rcols]))

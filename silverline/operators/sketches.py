"""Quantiles of groups from mergeable KLL sketches (DAG5, DAG6, CAT7).

A sketch holds a few hundred values whatever the group's size, is built with partial aggregation, can be
stored per day and merged into longer periods: no task ever buffers the values of a hot group.  With ``K`` the rank error of a
quantile is within ``RANK_ERROR`` (KLL's bound for this size is about a third of it at 99 % confidence); groups of up to ``K`` values are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 400
RANK_ERROR = 0.02


def quantile_sketches(df: DataFrame, keys: list, value: str, k: int = K) -> DataFrame:
    """Rows (keys..., n, sketch): one sketch of the values that are not null per group."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(v, k).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: list, k: int = K) -> DataFrame:
    """Sketches of larger groups from those of their parts."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def quantiles(sketches: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """The sketches' keys and n with one column per named probability."""
    keep = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*keep, *[F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in probabilities.items()])


def rank_errors(df: DataFrame, keys: list[str], value: str, found: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """Exact rank error of each found quantile: how far its probability lies outside the ranks that its value has in ``df``.

    One join of the rows with the quantiles by group and counts below and up to each of them; nothing is sorted.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("__v"))
    found = found.select(*[F.col(c).alias(f"__k_{c}") for c in keys], *[F.col(c).alias(f"__q_{c}") for c in probabilities])
    same = [rows[c].eqNullSafe(found[f"__k_{c}"]) for c in keys]  # null groups count too
    joined = rows.join(found, same)
    counts = joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("__v") < F.col(f"__q_{c}")).alias(f"__lt_{c}") for c in probabilities],
                                       *[F.count_if(F.col("__v") <= F.col(f"__q_{c}")).alias(f"__le_{c}") for c in probabilities])
    zero = F.lit(0.0)
    return counts.select(*keys, "n", *[F.greatest(F.col(f"__lt_{c}") / F.col("n") - p, F.lit(p) - F.col(f"__le_{c}") / F.col("n"), zero).alias(c)
                                       for c, p in probabilities.items()])

"""Mixing sources to target weights: Poisson replication with hash-seeded counts and a global shuffle.

A source of size ``n`` (rows) with target weight ``w`` gets the mean repetition
rate ``w * total / n``.  Each document's count is the Poisson quantile of a
uniform number hashed from its id and the seed; the document is exploded by its
count and the copies are dealt and ordered by a hash of (id, copy, seed).
Everything is DataFrame expressions on the JVM.

Defined results: a null source is a source of its own; a null id hashes as the
empty string; repeated rows get the same count each; null and empty texts are
documents like any other; a source without a weight (or with weight 0) is left
out when weights are given; an empty table gives an empty table.  Columns of
the documents are all kept; if one is named like an output column of this
operator (``copy_no``, ``n_copies``), the operator's column takes its place.

Scale: source sizes are pre-aggregated in the map tasks; the table of rates
(one row per source) is written and re-read, so that Catalyst sees its true size
and broadcasts it only below the session's threshold.  A rate above ``PIECE`` is
dealt into equal independent pieces (a sum of Poissons is a Poisson), which
bounds the quantile table of any rate without a cap.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silverline.session import materialize

SEED = "mix-1"
#: largest mean handled by one quantile table
PIECE = 8.0
#: entries of a quantile table: beyond 64 the tail of a Poisson with mean 8 is under 2^-100
TERMS = 64
#: exponent that flattens source shares when no weights are given (1 keeps them, 0 makes sources equal)
ALPHA = 0.5


def uniform(key: Column, seed: str, piece: Column) -> Column:
    """A uniform number in [0, 1) from the first 52 bits of md5(seed:piece:key)."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), piece.cast("string"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, total: float | None = None,
                 alpha: float = ALPHA) -> DataFrame:
    """source, n_source, rate, pieces and the quantile table of one piece."""
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("n_source"))
    if weights is None:
        share = sizes.withColumn("w", F.pow(F.col("n_source").cast("double"), F.lit(alpha)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()] or [(None, 0.0)],
                                                  "s string, w double")
        share = sizes.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("s")), "left").withColumn(
            "w", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0))).drop("s")
    share = materialize(share, "mixing-sizes")
    sums = share.agg(F.sum("w").alias("w"), F.sum("n_source").alias("n")).first()  # two numbers
    goal = float(total if total is not None else sums["n"] or 0)
    scale = goal / sums["w"] if sums["w"] else 0.0
    rates = share.select("source", "n_source", (F.col("w") * F.lit(scale) / F.col("n_source")).alias("rate"))
    rates = rates.withColumn("pieces", F.greatest(F.ceil(F.col("rate") / F.lit(PIECE)), F.lit(1)).cast("int"))
    mean = F.col("rate") / F.col("pieces")
    # table[k] = P(X <= k), summed up from the terms mean^j exp(-mean) / j!
    terms = F.transform(F.sequence(F.lit(0), F.lit(TERMS - 1)),
                        lambda j: F.exp(-mean + j * F.ln(F.greatest(mean, F.lit(1e-300))) - _log_factorial(j)))
    sums_up = F.aggregate(terms, F.array().cast("array<double>"),
                          lambda acc, t: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + t)))
    return rates.withColumn("cdf", sums_up)


def _log_factorial(j: Column) -> Column:
    """ln(j!) from a fixed array, j < TERMS."""
    return F.element_at(F.array(*[F.lit(math.lgamma(k + 1.0)) for k in range(TERMS)]), j + 1)


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, total: float | None = None,
                alpha: float = ALPHA, seed: str = SEED) -> DataFrame:
    """``docs`` replicated to the target weights and shuffled; adds ``copy_no`` (from 1) and ``n_copies``."""
    rates = materialize(source_rates(docs, weights, total, alpha), "mixing-rates")
    names = [c for c in docs.columns if c.lower() not in ("copy_no", "n_copies")]
    r = rates.select(F.col("source").alias("__mix_source"), F.col("pieces").alias("__mix_pieces"), F.col("cdf").alias("__mix_cdf"))
    counts = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.col("__mix_pieces")), lambda p: F.size(F.filter(
            "__mix_cdf", lambda c: c <= uniform(F.col("doc_id"), seed, p)))),
        F.lit(0), lambda a, x: a + x)
    out = (docs.select(*names).join(r, F.col("source").cast("string").eqNullSafe(F.col("__mix_source")))
           .withColumn("n_copies", counts).where("n_copies > 0")
           .select(*names, "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy_no")))
    place = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy_no"))
    return (out.withColumn("__mix_place", place)
            .repartition(F.col("__mix_place")).sortWithinPartitions("__mix_place").drop("__mix_place"))

"""Joining per-key facts onto rows whose keys may be very unevenly spread.

``attach_per_key`` adds the columns of a one-row-per-key table to every row of
``rows`` with a plain equi-join: adaptive execution broadcasts the key table when
its bytes allow it and splits skewed partitions of the fact side otherwise.
Where adaptive skew handling is not available, ``salt_buckets`` replicates the key table
once per salt and deals the rows evenly over the salts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_per_key(rows: DataFrame, per_key: DataFrame, keys: list[str], how: str = "left",
                   salt_buckets: int | None = None) -> DataFrame:
    """Left/inner join of a one-row-per-key table onto ``rows``."""
    # key columns of the fact table are renamed and compared null-safely: a null key is a group too
    facts = per_key.select(*[F.col(f"`{c}`").alias(f"__k_{c}") if c in keys else F.col(f"`{c}`")
                             for c in per_key.columns])
    cond = [F.col(f"`{k}`").eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    drop = [f"__k_{k}" for k in keys]
    if not salt_buckets:
        return rows.join(facts, cond, how).drop(*drop)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salt_buckets))
    salted_rows = rows.withColumn("__salt", salt)
    salted_facts = facts.withColumn("__fsalt", F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))))
    cond = cond + [F.col("__salt") == F.col("__fsalt")]
    return salted_rows.join(salted_facts, cond, how).drop("__salt", "__fsalt", *drop)

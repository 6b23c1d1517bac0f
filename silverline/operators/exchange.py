"""Explicit exchanges."""

from __future__ import annotations

from pyspark.sql import DataFrame


def redistribute(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out by a hash of ``keys`` before expressions that cost far more than a shuffle.

    A Parquet row group is read by one task, so a table of few large row groups leaves most cores idle
    while regexes run for hundreds of CPU seconds a GB; moving the rows costs some tens.  The step is
    part of the plan whatever the input; the number of partitions is left to adaptive execution.
    ``keys`` should be near unique: rows with equal keys stay together.  Queries with cheap expressions do not need it.
    """
    return df.repartition(*keys)

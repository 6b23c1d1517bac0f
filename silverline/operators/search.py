"""Keyword search with source attribution (FLT1, FLT2, AGG16, JOIN5).

A case-insensitive substring test over the row text of the user columns.  It
is a narrow, filter-only plan (scan -> filter -> project); there is no scan
cap: every row of every dataset is searched.  ``limit`` gives a page of hits
in a stated order; the match count is always the true total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverline.functions import patterns as P
from silverline.operators.columns import row_text
from silverline.operators.joins import attach_per_key

PROVENANCE_FIELDS = [
    ("source_file", "_source_file"),
    ("file_type", "_source_type"),
    ("row_number", "_row_number"),
    ("dataset_id", "_dataset_id"),
    ("ingested_at", "_ingested_at"),
]


def matches(df: DataFrame, query: str, columns: list[str] | None = None):
    """Boolean column: the row text contains ``query``, ignoring case."""
    return F.contains(F.lower(row_text(df, columns)), F.lower(F.lit(query)))


def keyword_search(df: DataFrame, query: str, columns: list[str] | None = None,
                   order_by: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """FLT1: rows whose user-column text contains ``query`` (case-insensitive)."""
    hits = df.where(matches(df, query, columns))
    if limit is not None:
        hits = hits.orderBy(*(order_by or df.columns)).limit(limit)
    return hits


def provenance_search(df: DataFrame, query: str, datasets: DataFrame | None = None,
                      columns: list[str] | None = None) -> DataFrame:
    """FLT2 (+JOIN5): every match with its user columns and a flat provenance record.

    Missing provenance falls back to the dataset's name and type from ``datasets``
    (id, name, file_type), attached by broadcast after a size check, else a salted join.
    """
    user = columns or [c for c in df.columns if not c.startswith("_")]
    hits = df.where(matches(df, query, user))
    out = hits.select(*user, *[
        (F.col(src) if src in df.columns else F.lit(None)).alias(f"prov_{name}") for name, src in PROVENANCE_FIELDS
    ])
    if datasets is not None:
        ds = datasets.select(
            F.col("id").alias("prov_dataset_id"), F.col("name").alias("__ds_name"), F.col("file_type").alias("__ds_type"))
        out = attach_per_key(out, ds, ["prov_dataset_id"], how="left").withColumns({
            "prov_source_file": F.coalesce("prov_source_file", "__ds_name"),
            "prov_file_type": F.coalesce("prov_file_type", "__ds_type"),
        }).drop("__ds_name", "__ds_type")
    return out


def context_hints(hits: DataFrame, query: str, file_col: str = "prov_source_file") -> DataFrame:
    """AGG16: one row: total matches, distinct files, and the hints the reference adds
    (several source files; several matches).  Only counts travel, never the hit rows."""
    agg = hits.agg(
        F.count(F.lit(1)).alias("total_matches"),
        F.count_distinct(file_col).alias("total_files_matched"),
    )
    hints = F.array_compact(F.array(
        F.when(F.col("total_files_matched") > 1, F.lit(P.HINT_MULTIPLE_SOURCES)),
        F.when(F.col("total_matches") > 1, F.lit(P.HINT_MULTIPLE_MATCHES)),
    ))
    return agg.select(F.lit(query).alias("query"), "total_matches", "total_files_matched", hints.alias("hints"))

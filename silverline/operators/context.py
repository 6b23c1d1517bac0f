"""Context assembly for language-model prompts (CTX1, CTX2, CTX4) as batch jobs.

Per-group counts come from a ``groupBy`` (partial aggregation; a hot group is
pre-reduced on every executor) attached back to the rows by broadcast or a
salted join (``joins.attach_per_key``), never from a window over the whole group.  The packed context of a group is bounded by its
budget: each document contributes at most ``min(8000, 50000 div n)``
characters, so the text of one group never exceeds 50,000 characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from silverline.functions import patterns as P
from silverline.operators.joins import attach_per_key
from silverline.session import materialize


def _group_counts(df: DataFrame, group_col: str, name: str = "__n") -> DataFrame:
    return df.groupBy(group_col).agg(F.count(F.lit(1)).alias(name))


def context_blocks(docs: DataFrame, group_col: str, name_col: str, text_col: str, order_col: str | None = None,
                   max_chars: int | None = None, total_chars: int | None = None) -> DataFrame:
    """CTX1 in long form: one ``=== name ===`` block per document with its budgeted text.

    budget = min(max_chars, total_chars div documents in the group); without these limits the whole text.  Columns: group, file,
    order (``order_col``, default the name), files, budget, block.
    """
    d = attach_per_key(docs, _group_counts(docs, group_col), [group_col], how="inner")
    most = [F.lit(2**31 - 1)] * 2
    if max_chars is not None:
        most.append(F.lit(max_chars))
    if total_chars is not None:
        most.append(F.floor(F.lit(total_chars) / F.col("__n")).cast("int"))
    budget = F.least(*most)
    return d.select(
        group_col, F.col(name_col).alias("file"), F.col(order_col or name_col).alias("order"),
        F.col("__n").alias("files"), budget.alias("budget"),
        F.concat(F.lit(P.CONTEXT_HEADER[0]), F.col(name_col), F.lit(P.CONTEXT_HEADER[1]),
                 F.substring(F.coalesce(F.col(text_col), F.lit("")), F.lit(1), budget)).alias("block"),
    )


def pack_context(docs: DataFrame, group_col: str, name_col: str, text_col: str, order_col: str | None = None,
                 max_chars: int | None = None, total_chars: int | None = None) -> DataFrame:
    """CTX1: per group the packed context (blocks joined by a blank line, in ``order_col`` order),
    the file list ("• name" lines) and the number of files."""
    blocks = context_blocks(docs, group_col, name_col, text_col, order_col, max_chars, total_chars)
    agg = blocks.groupBy(group_col).agg(
        F.sort_array(F.collect_list(F.struct("order", "block", "file"))).alias("__b"),
        F.max("files").alias("files"),
    )
    return agg.select(
        group_col, "files",
        F.array_join(F.transform("__b", lambda x: x["block"]), P.CONTEXT_SEPARATOR).alias("context"),
        F.array_join(F.transform("__b", lambda x: F.concat(F.lit(P.FILE_BULLET), x["file"])), "\n").alias("file_list"),
    )


def context_parts(docs: DataFrame, group_col: str, name_col: str, text_col: str, order_col: str, part_chars: int) -> DataFrame:
    """CTX1 over whole texts: per group the context of ``pack_context`` without limits, in numbered parts of ``part_chars``
    characters (the last may be shorter).  Columns: group, files (of the group), part (from 1), context, file_list (files in the part).

    The parts of a group in order, put together, are its whole context.  Null names and texts read as empty; equal orders go
    by the text's md5.  A group is spread over tasks: rows are sorted in ranges, each range adds up its lengths, and the table
    of ranges (at most partitions + groups rows) gives their offsets.
    """
    name = F.coalesce(F.col(name_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    block = F.concat(F.lit(P.CONTEXT_SEPARATOR + P.CONTEXT_HEADER[0]), name, F.lit(P.CONTEXT_HEADER[1]), text)
    rows = docs.select(F.col(group_col).alias("g"), F.col(order_col).alias("o"), F.md5(text).alias("h"), name.alias("file"), block.alias("block"))
    keys = ["g", "o", "h"]
    ranged = rows.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    ranged = ranged.select(F.spark_partition_id().alias("pid"), "g", "file", "block", F.length("block").cast("long").alias("chars"))

    def add_up(batches):
        import pyarrow as pa

        group, at = None, 0
        for batch in batches:
            before = []
            for g, n in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True):
                group, at = (g, at) if g == group else (g, 0)
                before.append(at)
                at += n
            yield pa.record_batch([*batch.columns, pa.array(before, pa.int64())], names=["pid", "g", "file", "block", "chars", "before"])

    schema = StructType([*ranged.schema.fields, StructField("before", LongType())])
    ranged = materialize(ranged.mapInArrow(add_up, schema), "context-parts")
    slices = ranged.groupBy("pid", "g").agg(F.sum("chars").alias("n"), F.count("*").alias("rows"))
    earlier, group = Window.partitionBy("g").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("g")
    slices = slices.select(F.col("pid").alias("s_pid"), F.col("g").alias("s_g"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"),
                           F.sum("rows").over(group).alias("files"))
    placed = ranged.join(slices, (F.col("pid") == F.col("s_pid")) & F.col("g").eqNullSafe(F.col("s_g")))
    # the separator before a group's first block lies before its context
    gap, size = len(P.CONTEXT_SEPARATOR), F.lit(part_chars)
    start = F.col("offset") + F.col("before") - gap
    placed = placed.select("g", "files", "file", "block", "chars", start.alias("start"))
    first, last = F.greatest(F.col("start"), F.lit(0)), F.col("start") + F.col("chars") - 1
    pieces = placed.withColumn("part", F.explode(F.sequence(F.floor(first / size), F.floor(last / size))))
    lo = F.greatest(F.col("part") * size, F.lit(0)) - F.col("start")
    lo, hi = F.greatest(lo, F.lit(0)), F.least((F.col("part") + 1) * size - F.col("start"), F.col("chars"))
    pieces = pieces.select("g", "files", "part", F.struct("start", F.substring("block", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("piece"),
                                                          "file").alias("x"))
    packed = pieces.groupBy("g", "files", "part").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return packed.select(F.col("g").alias(group_col), "files", (F.col("part") + 1).alias("part"),
                         F.array_join(F.transform("x", lambda x: x["piece"]), "").alias("context"),
                         F.array_join(F.transform("x", lambda x: F.concat(F.lit(P.FILE_BULLET), x["file"])), "\n").alias("file_list"))


def sample_rows_context(df: DataFrame, group_col: str, order_col: str, n: int = 100,
                        columns: list[str] | None = None) -> DataFrame:
    """CTX2: per dataset the first ``n`` rows (in ``order_col`` order) as a JSON array of objects."""
    from silverline.operators.catalog import newest_per_group

    cols = columns or [c for c in df.columns if not c.startswith("_") and c != group_col]
    first = newest_per_group(df, group_col, [F.col(order_col)], n)
    agg = first.groupBy(group_col).agg(
        F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("__o"),
                                             F.to_json(F.struct(*cols)).alias("j")))).alias("__rows"),
        F.count(F.lit(1)).alias("preview_rows"),
    )
    return agg.select(group_col, "preview_rows",
                      F.concat(F.lit("["), F.array_join(F.transform("__rows", lambda x: x["j"]), ","), F.lit("]"))
                      .alias("rows_json"))


def raw_documents(docs: DataFrame, group_col: str, order_cols: list, n: int, text_col: str,
                  excerpt_chars: int | None = None) -> DataFrame:
    """CTX4: newest ``n`` documents per group with the group's total document count.

    ``excerpt_chars`` optionally cuts each text (the reference used ``P.RAW_DOCUMENT_CHARS``);
    the default keeps whole texts.
    """
    from silverline.operators.catalog import newest_per_group

    newest = newest_per_group(docs, group_col, order_cols, n)
    if excerpt_chars:
        newest = newest.withColumn(text_col, F.substring(text_col, 1, excerpt_chars))
    return attach_per_key(newest, _group_counts(docs, group_col, "total_documents"), [group_col], how="inner")

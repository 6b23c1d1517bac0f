"""Readers (SRC1-SRC6, SRC8).

All readers are Spark data sources.  ``ingest_files`` lists a directory once (paths only -
``binaryFile`` prunes the content column) and discovers the schema of every file in Spark: the
first line of each CSV and JSON file, the footers of the Parquet files.  Files with one
signature are one distributed scan (a JSON document must not lie under a path with pattern characters: Spark's
own multi-line reader takes those as a pattern), so a directory of a million CSV files under three
different headers is three scans, not a loop; the scans of a type are united by column name.
Files with extensions outside the whitelist and records that do not parse become rows of an error frame.
"""

from __future__ import annotations

import os
import re
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silverline.operators.columns import flatten, normalize_columns

# FIXED VALUES: upload whitelist of the reference (its per-file readers for pdf/office
# formats are not built; those files are reported as unsupported here).
ALLOWED_EXTENSIONS = [".csv", ".json", ".parquet", ".pdf", ".xlsx", ".xls", ".docx", ".doc", ".txt", ".xml",
                      ".html", ".htm", ".pptx", ".ppt"]
#: extension -> source type tag written to ``_source_type``
TEXT_TYPES = {".txt": "txt", ".xml": "xml", ".html": "html", ".htm": "htm", ".md": "text"}
READABLE = {".csv": "csv", ".json": "json", ".parquet": "parquet", **TEXT_TYPES}


def read_csv(spark: SparkSession, paths, schema: T.StructType | str | None = None, header: bool = True,
             sampling_ratio: float = 1.0) -> DataFrame:
    """SRC1: CSV with a header; an explicit schema when known, else inferred types."""
    r = spark.read.option("header", header).option("mode", "PERMISSIVE")
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True).option("samplingRatio", sampling_ratio)
    return r.csv(paths)


def read_json(spark: SparkSession, paths, schema: T.StructType | str | None = None,
              multi_line: bool = False) -> DataFrame:
    """SRC2: JSON lines, or (``multi_line``) files holding one array/object each."""
    r = spark.read.option("multiLine", multi_line)
    if schema is not None:
        r = r.schema(schema)
    return r.json(paths)


def read_json_flat(spark: SparkSession, paths, schema=None, multi_line: bool = False) -> DataFrame:
    """SRC2 + SRC3: JSON with nested objects flattened and headers cleaned (``a.b`` -> ``ab``)."""
    return flatten(read_json(spark, paths, schema, multi_line))


def read_parquet(spark: SparkSession, paths) -> DataFrame:
    """SRC4."""
    return spark.read.parquet(*paths) if isinstance(paths, (list, tuple)) else spark.read.parquet(paths)


def utf8_text(binary_col: str = "content", ignore_bad_bytes: bool = True):
    """Bytes -> text as UTF-8 without failing on malformed input.

    Spark 4's ``decode`` raises on malformed UTF-8, so the bytes are reinterpreted as a
    string and repaired with ``make_valid_utf8`` (each bad sequence becomes U+FFFD), which
    is then dropped - the "ignore" error mode of the reference's file reader.
    """
    raw, text = F.expr(f"cast(`{binary_col}` as string)"), F.expr(f"make_valid_utf8(cast(`{binary_col}` as string))")
    # a file without bad bytes stays as it is, also where it holds U+FFFD itself
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(text, F.lit("\ufffd"), F.lit(""))) if ignore_bad_bytes else text


def read_whole_text(spark: SparkSession, paths, ignore_bad_bytes: bool = True) -> DataFrame:
    """SRC5: one row per file: ``content`` (UTF-8; undecodable bytes dropped) and ``_source_file``."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(utf8_text("content", ignore_bad_bytes).alias("content"), F.col("path").alias("_source_file"))


def read_dataset(spark: SparkSession, root: str, dataset_ids: list[str] | None = None,
                 partition_col: str = "_dataset_id") -> DataFrame:
    """Stored datasets (SNK1 layout); a dataset filter prunes partitions at the scan (FLT3)."""
    df = spark.read.parquet(root)
    return df.where(F.col(partition_col).isin(*dataset_ids)) if dataset_ids else df


def file_stats(df: DataFrame) -> DataFrame:
    """SRC8: per stored file: path, size in bytes and row count (from the hidden ``_metadata``)."""
    return df.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size")) \
        .groupBy("file_path").agg(F.max("file_size").alias("file_size"), F.count(F.lit(1)).alias("row_count"))


def list_files(spark: SparkSession, directory: str, recursive: bool = True) -> DataFrame:
    """Paths and sizes under ``directory`` (content is not read)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(directory)
            .select("path", "length", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("ext")))


def _glob(ext: str) -> str:
    """Case-insensitive file glob for an extension (``.csv`` -> ``*.[cC][sS][vV]``)."""
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)


CORRUPT = "_corrupt_record"
#: characters of a first line that tell a header from another
HEAD = 65_536


def first_lines(spark: SparkSession, directory: str, ext: str) -> DataFrame:
    """First line with text of every file: ``path``, ``head`` (its first ``HEAD`` characters), ``whole`` (it is one JSON value by itself).

    One scan of the files' text with a partial minimum per file: a row per file and task moves.
    """
    lines = spark.read.options(pathGlobFilter=_glob(ext), recursiveFileLookup="true").text(directory)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                         F.regexp_replace("value", "^\ufeff", "").alias("value")).where("start = 0")
    lines = lines.where(F.trim("value") != "").withColumn("at", F.monotonically_increasing_id())
    json_value = F.get_json_object("value", "$") if ext == ".json" else F.lit(None)
    first = F.struct(F.substring("value", 1, HEAD).alias("head"), json_value.isNotNull().alias("whole"))
    return lines.groupBy("path").agg(F.min_by(first, "at").alias("first")).select("path", "first.*")


def schema_groups(spark: SparkSession, directory: str, ext: str) -> dict[str, list[str]]:
    """Paths by signature: the header line of CSV files; ``lines`` or ``document`` for JSON files.

    A JSON file whose first line is an object by itself holds JSON lines; an array, or a value
    that goes on after its first line, is one document.  Only paths reach the driver, which keeps them for any scan.
    """
    heads = first_lines(spark, directory, ext)
    if ext == ".json":
        lines = F.col("whole") & F.ltrim("head").startswith("{")
        heads = heads.withColumn("head", F.when(lines, F.lit("lines")).otherwise(F.lit("document")))
    else:
        heads = heads.withColumn("head", F.rtrim(F.regexp_replace("head", "\r$", "")))
    return {r["head"]: r["paths"] for r in heads.groupBy("head").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()}


def literal_paths(paths: list[str]) -> list[str]:
    """Paths that a reader takes as they are (it would read ``[`` or ``*`` as a pattern)."""
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]


def _as_paths(urls: list[str]) -> list[str]:
    """Literal paths of a scan's own file names, which are URL-encoded."""
    return literal_paths([unquote(u) for u in urls])


def _read_csv_group(spark: SparkSession, paths: list[str]) -> DataFrame:
    reader = spark.read.options(header="true", recursiveFileLookup="true", mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, columnPruning="false")
    schema = reader.option("inferSchema", True).csv(paths).schema
    return reader.option("inferSchema", False).schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])).csv(paths)


def _read_json_group(spark: SparkSession, paths: list[str], document: bool) -> DataFrame:
    reader = spark.read.options(multiLine=str(document).lower(), recursiveFileLookup="true", mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    fields = [f for f in reader.json(paths).schema.fields if f.name != CORRUPT]
    return reader.schema(T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])).json(paths)


def _parquet_groups(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    """Parquet files by columns that merge: missing columns read as null; a column of two types splits the files until each part merges."""
    try:
        return [spark.read.options(mergeSchema="true", recursiveFileLookup="true").parquet(*paths)]
    except (PySparkException, Py4JJavaError) as e:
        if len(paths) == 1 or "CANNOT_MERGE" not in str(e):
            raise
    half = len(paths) // 2
    return _parquet_groups(spark, paths[:half]) + _parquet_groups(spark, paths[half:])


_NUMBERS = ["tinyint", "smallint", "int", "bigint", "float", "double"]


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that keeps the values of both: the wider number (a bigint beside a fraction is a string), else string."""
    x, y = a.simpleString(), b.simpleString()
    if x == y or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if x in _NUMBERS and y in _NUMBERS and not ("bigint" in (x, y) and {x, y} & {"float", "double"}) and {x, y} != {"int", "float"}:
        return a if _NUMBERS.index(x) > _NUMBERS.index(y) else b
    return T.StringType()


def unite(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; a column that one lacks is null there, one with two types gets their common type."""
    kinds: dict[str, T.DataType] = {}
    for df in frames:
        for f in df.schema.fields:
            kinds[f.name] = common_type(kinds[f.name], f.dataType) if f.name in kinds else f.dataType

    def cast(df: DataFrame) -> DataFrame:
        def column(f):
            c = F.col(f"`{f.name}`")
            if f.dataType == kinds[f.name]:
                return c
            nested = isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) and isinstance(kinds[f.name], T.StringType)
            return (F.to_json(c) if nested else c.cast(kinds[f.name])).alias(f.name)

        return df.select([column(f) for f in df.schema.fields])

    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [cast(df) for df in frames])


def ingest_files(spark: SparkSession, directory: str, normalize: bool = True) -> tuple[dict[str, DataFrame], DataFrame]:
    """SRC6: read every supported file under ``directory``, one reader per type and schema.

    Returns ({source type: DataFrame with ``_source_file``/``_source_type``}, errors).  CSV files are
    grouped by their header, JSON files by their form (SRC2: lines, or an array or object a file), Parquet files by columns that
    merge; the groups of a type are united by column name (headers cleaned first when ``normalize``).
    Markup and text files become one ``content`` row per file.  ``errors`` (path, ext, reason, record,
    parsed) has the files without a reader and each record that does not parse (too few or too many
    fields, broken JSON) with the fields it did yield; such records are not in the frames.  Files
    without any text have no rows.
    """
    listing = list_files(spark, directory)
    exts = [r["ext"] for r in listing.select("ext").distinct().collect()]
    groups: dict[str, list[DataFrame]] = {}
    broken: list[DataFrame] = []
    for ext in sorted(e for e in exts if e in READABLE):
        kind = READABLE[ext]
        if kind in TEXT_TYPES.values():
            files = spark.read.format("binaryFile").options(pathGlobFilter=_glob(ext), recursiveFileLookup="true").load(directory)
            found = [files.select(utf8_text("content").alias("content"), F.col("path").alias("_source_file"))]
        elif kind == "parquet":
            found = _parquet_groups(spark, literal_paths([r["path"] for r in listing.where(F.col("ext") == ext).select("path").orderBy("path").collect()]))
        else:
            found = [_read_csv_group(spark, _as_paths(paths)) if kind == "csv" else _read_json_group(spark, _as_paths(paths), form == "document")
                     for form, paths in sorted(schema_groups(spark, directory, ext).items())]
        for df in found:
            if kind not in TEXT_TYPES.values():
                # the hidden _metadata column resolves on the scan itself, before any projection
                df = df.withColumn("_source_file", F.col("_metadata.file_path"))
            if CORRUPT in df.columns:
                values = [F.col(f"`{c}`") for c in df.columns if c not in (CORRUPT, "_source_file")]
                parsed = F.to_json(F.struct(*values))
                # Spark's readers want another column read beside the broken record
                broken.append(df.where(F.col(CORRUPT).isNotNull() & (F.coalesce(F.length(parsed), F.lit(0)) >= 0)).select(
                    F.col("_source_file").alias("path"), F.lit(ext).alias("ext"), F.lit("malformed record").alias("reason"),
                    F.col(CORRUPT).alias("record"), parsed.alias("parsed")))
                df = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
            if normalize and kind not in TEXT_TYPES.values():
                df = normalize_columns(df, strip_underscore=False, keep_internal=True)
            groups.setdefault(kind, []).append(df.withColumn("_source_type", F.lit(kind)))
    errors = listing.where(~F.col("ext").isin(*READABLE)).select(
        "path", "ext",
        F.when(F.col("ext").isin(*ALLOWED_EXTENSIONS), F.lit("no reader for this format"))
        .otherwise(F.lit("unsupported extension")).alias("reason"), F.lit(None).cast("string").alias("record"), F.lit(None).cast("string").alias("parsed"))
    return {kind: unite(found) for kind, found in groups.items()}, reduce(DataFrame.unionByName, broken, errors)


def basename(path: str) -> str:
    return os.path.basename(path.rstrip("/"))

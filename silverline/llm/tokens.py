"""Token counts by separator scan over flat, unindexed token files.

A token file is nothing but little-endian token ids, with an end-of-document id
after each document.  Files are cut into blocks of equal size that tasks read by
offset; each block is searched for the id with one vectorised comparison.  A
prefix scan over the blocks of a file (number of separators and last separator so
far) then stitches documents that cross block bounds.

Writing uses Spark's text writer: a row is a document's token bytes and the line
separator is the end-of-document id, so the writer's commit protocol holds.

Defined results: null and empty texts are documents of 0 tokens; repeated rows are
documents of their own; tokens after the last separator are one more document
with ``terminated`` false; an empty file has no documents; an empty table
gives no rows; other columns are not used.  A file whose size is no
multiple of the token width is an error.

Scale: blocks bound the memory of a task whatever the size of a file; one thin row
per block moves in the prefix scan, positions stay block by block.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silverline.session import materialize, shared_dir

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
EOD = 50256
WIDTH = 2
#: bytes of a block
BLOCK = 4 << 20


def _encoding(path: str):
    """The public byte-level BPE in ``path``, loaded once per worker."""
    found = _ENCODINGS.get(path)
    if found is None:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        found = _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return found


_ENCODINGS: dict = {}


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, eod: int = EOD, width: int = WIDTH) -> str:
    """Tokenise ``docs.text`` into flat token files under ``path``, in the order of the rows of each partition."""
    kind = np.dtype(f"<u{width}")

    def encode(batches):
        import pyarrow as pa

        enc = _encoding(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(0).slice(at, 256).to_pylist()
                yield pa.record_batch([pa.array([np.array(enc.encode_ordinary(t or ""), kind).tobytes() for t in texts], pa.binary())],
                                      names=["ids"])

    # ISO-8859-1 makes each character of the separator one byte
    (docs.select(F.col("text").cast("string")).mapInArrow(encode, "ids binary").select(F.col("ids").cast("string").alias("value"))
     .write.option("encoding", "ISO-8859-1").option("lineSep", eod.to_bytes(width, "little").decode("latin-1")).text(path))
    return path


def _open(path: str):
    """A random-access file in the file system of ``path``."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file://" + path[5:]
    system, name = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def count_tokens(spark: SparkSession, path: str, eod: int = EOD, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """file, doc_no (from 0 in the file), start_token, n_tokens, terminated of every document in the files under ``path``."""
    block -= block % width
    kind = np.dtype(f"<u{width}")
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))
    todo = (files.where("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {block}"))).alias("block"))
            .repartition(F.col("file"), F.col("block")))

    def scan(batches):
        import pyarrow as pa
        from urllib.parse import unquote

        for batch in batches:
            for name, size, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size % width:
                    raise ValueError(f"{name}: {size} bytes are no whole number of tokens")
                with _open(unquote(name)) as f:
                    ids = np.frombuffer(f.read_at(min(block, size - i * block), i * block), kind)
                at = np.flatnonzero(ids == eod) + i * (block // width)
                yield pa.record_batch([pa.array([name]), pa.array([i], pa.int64()), pa.array([size // width], pa.int64()),
                                       pa.array([at], pa.list_(pa.int64()))], names=["file", "block", "tokens", "at"])

    found = materialize(todo.mapInArrow(scan, "file string, block long, tokens long, at array<long>"), "token-blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = found.select("file", "block", F.size("at").alias("n"), F.try_element_at("at", F.lit(-1)).alias("last")).select(
        "file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("docs"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("last"))
    joined = found.join(carry, ["file", "block"])
    ends = joined.select("file", "docs", "last", "at", F.posexplode("at").alias("k", "stop"))
    start = F.when(F.col("k") > 0, F.try_element_at("at", F.col("k"))).otherwise(F.col("last")) + 1
    whole = ends.select("file", (F.col("docs") + F.col("k")).alias("doc_no"), start.alias("start_token"),
                        (F.col("stop") - start).alias("n_tokens"), F.lit(True).alias("terminated"))
    rest = (found.groupBy("file").agg(F.sum(F.size("at")).cast("long").alias("doc_no"), F.max("tokens").alias("tokens"),
                                      (F.coalesce(F.max(F.try_element_at("at", F.lit(-1))), F.lit(-1)) + 1).alias("start_token"))
            .where("tokens > start_token")
            .select("file", "doc_no", "start_token", (F.col("tokens") - F.col("start_token")).alias("n_tokens"), F.lit(False).alias("terminated")))
    return whole.unionByName(rest)


def document_token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, block: int = BLOCK) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and count the tokens of every document in them."""
    spark = docs.sparkSession
    path = write_tokens(docs, shared_dir(spark, f"tokens/{uuid.uuid4().hex}"), tokenizer)
    name = F.regexp_extract("file", r"part-(\d+)", 1)
    return count_tokens(spark, path, block=block).select(
        F.concat(F.lit("part-"), name, F.coalesce(F.regexp_extract("file", r"(-c\d+)", 1), F.lit(""))).alias("file"),
        F.col("doc_no").cast("long").alias("doc_no"), "start_token", "n_tokens")

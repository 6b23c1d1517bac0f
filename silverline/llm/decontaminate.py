"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training windows.

Words: A-Z lower-cased, then runs of digits, a-z and characters beyond ASCII.  A
benchmark item gives one window per 10 consecutive words; an item with fewer
words (but some) is one window.  Every document window whose hash is in the set is
verified word by word before it counts.

Defined results: a null or empty text has no words and is clean; repeated rows
are each reported; an empty benchmark leaves every document clean; items
without words have no windows; a null ``item_id`` contaminates a document but is
not listed; other columns, whatever their names, are passed through untouched.

Scale: documents are scanned in one narrow pass, without a shuffle.  The windows
are broadcast only in blocks of at most ``BLOCK_WINDOWS`` windows and
``BLOCK_BYTES`` bytes; a larger benchmark is dealt into several such blocks
and the documents are scanned once per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from silverline.session import materialize

from .words import ALNUM, Block, blocks, text_bytes, windows

N = 10
#: most windows, and bytes of their words, in one broadcast block
BLOCK_WINDOWS = 1_000_000
BLOCK_BYTES = 128 << 20

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def benchmark_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """One row per distinct window: hash, number of words, the words, and the item (null if it has no id)."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for b in blocks(text_bytes(batch.column(1)), ALNUM):
                at = 0
                for i, count in zip(range(b.lo, b.hi), b.counts.tolist(), strict=True):
                    size = min(n, count)
                    for j, h in enumerate(windows(b.hashes[at:at + count], size).tolist() if size else ()):
                        words = b" ".join(b.word(at + j + k) for k in range(size))
                        rows.append((np.int64(np.uint64(h)), size, words, ids[i]))
                    at += count
            cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                                   pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.string())],
                                  names=["hash", "size", "words", "item_id"])

    return (benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
            .mapInArrow(cut, "hash long, size int, words binary, item_id string").distinct())


class WindowSet:
    """One broadcast block: windows by length, with a bitmap in front of the sorted hashes."""

    BITS = 22

    def __init__(self, rows):
        self.words: dict[bytes, list[str]] = {}
        sizes: dict[int, set[int]] = {}
        for r in rows:
            self.words.setdefault(bytes(r["words"]), []).append(r["item_id"])
            sizes.setdefault(r["size"], set()).add(r["hash"])
        self.hashes = {k: np.sort(np.array(sorted(v), np.int64).view(np.uint64)) for k, v in sizes.items()}
        self.maps = {}
        for k, h in self.hashes.items():
            self.maps[k] = bits = np.zeros(1 << self.BITS, bool)
            bits[h >> np.uint64(64 - self.BITS)] = True

    def hits(self, b: Block) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, number of words, items) of every verified window in the block."""
        ends = np.cumsum(b.counts)
        for size, known in self.hashes.items():
            w = windows(b.hashes, size)
            maybe = np.flatnonzero(self.maps[size][w >> np.uint64(64 - self.BITS)])
            if not len(maybe):
                continue
            at = np.searchsorted(known, w[maybe])
            maybe = maybe[known[np.minimum(at, len(known) - 1)] == w[maybe]]
            within = maybe + size <= ends[np.searchsorted(ends, maybe, side="right")]
            for i in maybe[within].tolist():
                items = self.words.get(b" ".join(b.word(i + k) for k in range(size)))
                if items is not None:
                    yield i, size, items


def _sets(benchmark: DataFrame, n: int):
    """Broadcast blocks of the benchmark's windows, each within the bounds."""
    spark = benchmark.sparkSession
    found = materialize(benchmark_windows(benchmark, n), "decontaminate-windows")
    size = found.agg(F.count("*").alias("n"), F.sum(F.length("words") + F.lit(32)).alias("b")).first()
    k = max(1, -(-size["n"] // BLOCK_WINDOWS), -(-(size["b"] or 0) // BLOCK_BYTES))
    for i in range(k):
        part = found if k == 1 else found.where(F.pmod(F.xxhash64("words"), F.lit(k)) == i)
        yield k, spark.sparkContext.broadcast(WindowSet(part.collect()))


def _marks(b: Block, known: WindowSet) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words of the block are hit; the items found, by text."""
    edge = np.zeros(len(b.hashes) + 1, np.int64)
    items: dict[int, set[str]] = {}
    ends = np.cumsum(b.counts)
    for i, size, names in known.hits(b):
        edge[i] += 1
        edge[i + size] -= 1
        items.setdefault(b.lo + int(np.searchsorted(ends, i, side="right")), set()).update(names)
    return np.cumsum(edge[:-1]) > 0, items


def _slices(batches, rows: int = 1024):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """Per document row: words, hit words, items with occurring windows, and their digest."""
    parts = list(_sets(benchmark, n))
    several = len(parts) > 1

    def scan(known_bc):
        def run(batches):
            import pyarrow as pa

            known = known_bc.value
            for batch in _slices(batches):
                n_words, spans, found = [], [], []
                for b in blocks(text_bytes(batch.column(1)), ALNUM):
                    hit, items = _marks(b, known)
                    at = 0
                    for i, count in zip(range(b.lo, b.hi), b.counts.tolist(), strict=True):
                        n_words.append(count)
                        spans.append(np.flatnonzero(hit[at:at + count]) if i in items else ())
                        found.append(sorted(x for x in items.get(i, ()) if x is not None))
                        at += count
                if several:
                    yield pa.record_batch([batch.column(0), batch.column(2), pa.array(n_words, pa.int64()),
                                           pa.array(spans, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))],
                                          names=["doc_id", "text_hash", "n_words", "spans", "items"])
                    continue
                hits = [len(s) for s in spans]
                digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in found]
                yield pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), pa.array(hits, pa.int64()),
                                       pa.array([len(x) for x in found], pa.int64()), pa.array(digest, pa.string()),
                                       pa.array([h > 0 for h in hits], pa.bool_())],
                                      names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
        return run

    thin = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if not several:
        return thin.mapInArrow(scan(parts[0][1]), RESULT)
    # several blocks: a row per document and block, merged by document and text (equal rows have equal results)
    keyed = thin.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    schema = "doc_id long, text_hash long, n_words long, spans array<long>, items array<string>"
    merged = None
    for _, known in parts:
        one = materialize(keyed.mapInArrow(scan(known), schema), "decontaminate-block")
        merged = one if merged is None else merged.unionByName(one)
    per = merged.groupBy("doc_id", "text_hash").agg(
        F.first("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    out = keyed.select("doc_id", "text_hash").alias("d").join(
        per.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_hash") == F.col("p.text_hash")))
    return out.select("d.doc_id", "n_words", F.size("spans").cast("long").alias("n_hit"),
                      F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                      (F.size("spans") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, remove: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents, or (``remove='spans'``) with the hit words cut from their texts.

    All columns and their types stay as they are.  With several broadcast blocks, each is held against the text as given;
    the hit words of all blocks are cut once, after the last, so the blocking does not change the result.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    at = [c.lower() for c in docs.columns].index("text")

    mark = "hits"
    while mark in [c.lower() for c in docs.columns]:
        mark += "_"

    def drop(known_bc):
        def run(batches):
            import pyarrow as pa

            for batch in _slices(batches):
                keep = np.ones(batch.num_rows, bool)
                for b in blocks(text_bytes(batch.column(at)), ALNUM):
                    keep[list(_marks(b, known_bc.value)[1])] = False
                yield batch.filter(pa.array(keep))
        return run

    def cut(known_bc, first, last):
        """Add the hit words of a block to those of the blocks before it (positions, in the last column); the last one cuts."""
        def run(batches):
            import pyarrow as pa

            for batch in _slices(batches):
                texts = text_bytes(batch.column(at))
                hits = [None] * batch.num_rows if first else batch.column(batch.num_columns - 1).to_pylist()
                if not first:
                    batch = batch.select(range(batch.num_columns - 1))
                values = batch.column(at).to_pylist()
                for b in blocks(texts, ALNUM):
                    hit, items = _marks(b, known_bc.value)
                    ends = np.cumsum(b.counts)
                    bounds = np.cumsum([len(t) + 1 for t in texts[b.lo:b.hi]])
                    for i in range(b.lo, b.hi):
                        if i not in items and hits[i] is None:
                            continue
                        lo, hi = ends[i - b.lo] - b.counts[i - b.lo], ends[i - b.lo]
                        hit[lo:hi][hits[i] or []] = True
                        hits[i] = np.flatnonzero(hit[lo:hi]).tolist()
                        if last:
                            shift = int(bounds[i - b.lo]) - len(texts[i]) - 1
                            out, end = [], 0
                            for w in hits[i]:
                                out.append(texts[i][end:b.starts[lo + w] - shift])
                                end = b.ends[lo + w] - shift
                            values[i] = (b"".join(out) + texts[i][end:]).decode("utf-8", "replace")
                if last:
                    yield batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))
                else:
                    yield pa.record_batch([*batch.columns, pa.array(hits, pa.list_(pa.int64()))], names=[*batch.schema.names, mark])
        return run

    parts, schema = list(_sets(benchmark, n)), docs.schema
    for i, (k, known) in enumerate(parts):
        if remove == "documents":
            docs = docs.mapInArrow(drop(known), schema)
        else:
            marked = StructType([*schema.fields, StructField(mark, ArrayType(LongType()))])
            docs = docs.mapInArrow(cut(known, i == 0, i == k - 1), schema if i == k - 1 else marked)
    return docs

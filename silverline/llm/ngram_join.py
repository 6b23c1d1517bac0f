"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

A document's row holds its distinct five-word shingles.  Documents link when
``100 * |A and B| >= 75 * |A or B|``; the components of the links are returned.

1. Rows with equal sets are one class (a class key is a 64-bit set hash); everything
   below works on classes, so exact copies are never paired.
2. Columns are put in one order, rare n-grams first (a fixed-size count sketch over all
   documents gives the rarity).  The first block of a row are its first
   ``n - ceil(0.75 n) + 1`` columns: linked rows share at least one of them.
3. The first block names the pairs.  Those go that size-derived bounds rule out: sizes
   further apart than 0.75, too few columns left for the needed overlap, or parity
   signatures (512 bits, and one to two per n-gram between long sets) that differ in
   more places than linked sets can.  The rows of the others are multiplied block of
   columns by block of columns: overlap counts are summed by pair, a pair goes as soon
   as its count and its columns left fall short of the needed overlap, and later blocks
   are multiplied for the pairs that remain.  The summed count decides the link.
4. Not all pairs of a list are multiplied: rounds of neighbouring pairs (linear in a
   list) come first, then only pairs between different components, in
   which one side lies outside the largest component of the list.

Defined results: a document with fewer than five words is one shingle, its whole word
sequence; null, empty and blank texts have no shingle, link with nothing and are their
own component; repeated rows are all returned; rows with a null doc_id take part,
the component is the smallest non-null doc_id; an empty table gives an
empty table; other columns are ignored.

Scale: texts are read by narrow passes; only first-block entries are shuffled (a quarter
of the n-grams).  Lists of n-grams that the sketch puts over ``HOT`` rows are salted,
and the last product cuts lists into parts of about ``SPLIT`` rows.
Sets move only for pairs that survive the bounds.  Nothing but the sketch
(fixed size) comes to the driver; the ids of documents to re-read are
broadcast up to ``BROADCAST_IDS`` rows and shuffled beyond.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from silverline.session import materialize

from .words import NONSPACE, blocks, mix, text_bytes, windows

WORDS, SIMILARITY = 5, 75
SKETCH_BITS, SKETCH_PARTS = 20, 64
HOT = 50_000
#: rows of a list in one part of the last product
SPLIT = 2_000
BROADCAST_IDS = 1_000_000
LINEAR_ROUNDS = 3
#: column blocks of the product: equal ranges of the n-gram hashes
COLUMN_BLOCKS = 4
_SIGNATURE = [f"s{i}" for i in range(8)]
_LEAST = 64 * len(_SIGNATURE)
#: sets of more n-grams also have a wide signature
LONG = 640


def shingle_sets(texts: list[bytes], k: int = WORDS):
    """(text, sorted distinct shingle hashes) of every text."""
    for b in blocks(texts, NONSPACE):
        all_windows, at = windows(b.hashes, k), 0
        for i, n in zip(range(b.lo, b.hi), b.counts.tolist(), strict=True):
            yield i, (np.unique(all_windows[at:at + n - k + 1]) if n >= k else windows(b.hashes[at:at + n], n) if n else np.zeros(0, np.uint64))
            at += n


def _set_key(s: np.ndarray) -> int:
    """Class key of a set: an order-free hash with the size mixed in."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s + np.uint64(0x51ED270B)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _batches(batches, column: int):
    """(batch slice, texts) in slices of bounded size."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield part, text_bytes(part.column(column))


def _profile(docs: DataFrame, k: int) -> DataFrame:
    """Rows of documents (doc_id, key, n, signature), and of the sketch (part, counts of the part's cells)."""
    schema = "doc_id long, key long, n int, " + "".join(f"{c} long, " for c in _SIGNATURE) + "wide binary, part int, counts binary"
    names = ["doc_id", "key", "n", *_SIGNATURE, "wide", "part", "counts"]

    def run(batches):
        import pyarrow as pa

        cells = np.zeros(1 << SKETCH_BITS, np.uint32)
        for part, texts in _batches(batches, 1):
            key, n, sig, wide = [], [], np.zeros((part.num_rows, len(_SIGNATURE)), np.int64), []
            for i, s in shingle_sets(texts, k):
                n.append(len(s))
                key.append(_set_key(s) if len(s) else None)
                np.add.at(cells, s >> np.uint64(64 - SKETCH_BITS), np.uint32(1))
                size = 1 << len(s).bit_length() if len(s) > LONG else _LEAST
                bits = np.packbits((np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8))
                wide.append(bits.tobytes() if len(s) > LONG else None)
                sig[i] = np.bitwise_xor.reduce(bits.reshape(-1, _LEAST // 8), axis=0).view(np.int64)
            none = pa.nulls(part.num_rows, pa.int32())
            yield pa.record_batch([part.column(0), pa.array(key, pa.int64()), pa.array(n, pa.int32()), *(pa.array(sig[:, j]) for j in range(len(_SIGNATURE))),
                                   pa.array(wide, pa.binary()), none, pa.nulls(part.num_rows, pa.binary())], names=names)
        if cells.any():
            blobs = [c.tobytes() for c in np.split(cells, SKETCH_PARTS)]
            empty = pa.nulls(SKETCH_PARTS, pa.int64())
            yield pa.record_batch([empty, empty, pa.nulls(SKETCH_PARTS, pa.int32()), *[empty] * len(_SIGNATURE), pa.nulls(SKETCH_PARTS, pa.binary()),
                                   pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(blobs, pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _levels(profile: DataFrame) -> tuple[np.ndarray, float]:
    """Rarity level (0: rare) of every sketch cell, and the count of an ordinary cell."""

    def add(table):
        import pyarrow as pa

        total = sum((np.frombuffer(x, np.uint32).astype(np.int64) for x in table.column("counts").to_pylist()),
                    np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.int64))
        return pa.table({"part": table.column("part").slice(0, 1), "total": pa.array([total.tobytes()], pa.binary())})

    got = profile.where("part is not null").select("part", "counts").groupBy("part").applyInArrow(add, "part int, total binary").collect()
    if not got:
        return np.zeros(1 << SKETCH_BITS, np.uint8), 1.0
    cells = np.concatenate([np.frombuffer(r["total"], np.int64) for r in sorted(got, key=lambda r: r["part"])])
    usual = max(1.0, float(np.median(cells)))
    return np.floor(np.log2(np.maximum(cells / usual, 1.0))).astype(np.uint8), usual


def _needed(a: Column, b: Column, percent: int) -> Column:
    """Smallest overlap of two linked sets of sizes a and b."""
    return F.ceil((a + b) * F.lit(percent) / F.lit(100.0 + percent) - F.lit(1e-9))


def _first_block(docs: DataFrame, levels: np.ndarray, usual: float, k: int, percent: int, hot: int) -> DataFrame:
    """Entries (token, salt, key, n, left) of the first block; left: columns from this one on."""
    model = docs.sparkSession.sparkContext.broadcast(levels)
    salts = np.maximum(1, np.ceil(usual * 2.0 ** np.minimum(np.arange(256) + 1, 50) / hot)).astype(np.uint64)

    def run(batches):
        import pyarrow as pa

        level, seen = model.value, set()  # copies within a task are entered once
        for _, texts in _batches(batches, 0):
            token, salt, key, size, left = [], [], [], [], []
            for _, s in shingle_sets(texts, k):
                n = len(s)
                if not n or (of := _set_key(s)) in seen:
                    continue
                seen.add(of)
                lev = level[s >> np.uint64(64 - SKETCH_BITS)]
                first = np.argsort(lev, kind="stable")[:n + (-n * percent // 100) + 1]
                token.append(s[first])
                many = salts[lev[first]]
                salt.append(np.where(many > 1, (np.uint64(of & ((1 << 63) - 1)) % many).astype(np.int64), -1))
                key.append(np.full(len(first), of, np.int64))
                size.append(np.full(len(first), n, np.int32))
                left.append(n - np.arange(len(first), dtype=np.int32))
            if token:
                yield pa.record_batch([pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(salt).astype(np.int32)),
                                       pa.array(np.concatenate(key)), pa.array(np.concatenate(size)), pa.array(np.concatenate(left).astype(np.int32))],
                                      names=["token", "salt", "key", "n", "left"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "token long, salt int, key long, n int, left int")


def _keyed_sets(k: int):
    """The distinct sets of a task's texts with their class keys."""
    def run(batches):
        import pyarrow as pa

        seen = set()
        for _, texts in _batches(batches, 0):
            found = [(of, s.tobytes()) for _, s in shingle_sets(texts, k) if len(s) and (of := _set_key(s)) not in seen and not seen.add(of)]
            yield pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["key", "s"])

    return run


class _Sets:
    """Sets of classes, read again from the documents for the classes that pairs need."""

    def __init__(self, docs: DataFrame, members: DataFrame, k: int):
        self.docs, self.k, self.have = docs, k, None
        # the smallest doc_id of a class; null where all of its rows lack one
        self.first = members.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("id"))

    def of(self, keys: DataFrame) -> DataFrame:
        """key, s (bytes of the sorted set) of the given classes."""
        k = self.k
        keys = materialize(keys, "join-keys")
        few = keys.count() <= BROADCAST_IDS
        new = keys if self.have is None else keys.join(self.have.select("key"), "key", "left_anti")
        want = materialize(new.join(self.first, "key"), "join-wanted")
        if few:
            keys, want = F.broadcast(keys), F.broadcast(want)

        def run(batches):
            import pyarrow as pa

            seen = set()
            for part, texts in _batches(batches, 1):
                sets = {i: s for i, s in shingle_sets(texts, k)}
                # a doc_id may repeat with another text: only the text of the class counts
                fits = [i for i, of in enumerate(part.column(0).to_pylist())
                        if of not in seen and len(sets[i]) and _set_key(sets[i]) == of and not seen.add(of)]
                yield pa.record_batch([part.column(0).take(pa.array(fits, pa.int64())), pa.array([sets[i].tobytes() for i in fits], pa.binary())],
                                      names=["key", "s"])

        rows = self.docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(want, "id")
        new = rows.select("key", "text").mapInArrow(run, "key long, s binary")
        nameless = want.where("id is null").select("key")
        if not nameless.isEmpty():  # classes without any doc_id are found by their texts
            texts = self.docs.where("doc_id is null").select(F.col("text").cast("string").alias("text"))
            new = new.unionByName(texts.mapInArrow(_keyed_sets(k), "key long, s binary").join(nameless, "key", "left_semi").dropDuplicates(["key"]))
        new = materialize(new, "join-sets")
        self.have = new if self.have is None else self.have.unionByName(new)
        return self.have.join(keys, "key", "left_semi")


@dataclass
class _Signs:
    """Signatures by class: ``short`` (key, n, 512 bits) of all, ``long`` (key, wide) of sets over ``LONG``."""

    short: DataFrame
    long: DataFrame

    @classmethod
    def of(cls, members: DataFrame) -> _Signs:
        rows = members.where("key is not null")
        return cls(materialize(rows.select("key", "n", *_SIGNATURE).dropDuplicates(["key"]), "join-signs"),
                   materialize(rows.where("wide is not null").select("key", "wide").dropDuplicates(["key"]), "join-wide"))


def _differ(a: str, b: str) -> Column:
    """Places in which the signatures of two sides differ."""
    return sum((F.bit_count(F.col(a + s).bitwiseXOR(F.col(b + s))) for s in _SIGNATURE), F.lit(0))


def _plausible(pairs: DataFrame, signs: _Signs, percent: int) -> DataFrame:
    """The pairs whose signatures differ in no more places than those of linked sets of their sizes can."""
    for x in ("a", "b"):
        pairs = pairs.join(signs.short.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), *(F.col(s).alias(f"{x}_{s}") for s in _SIGNATURE)), x)
    na, nb = F.col("na"), F.col("nb")
    pairs = materialize(pairs.where(_differ("a_", "b_") <= na + nb - 2 * _needed(na, nb, percent)).select("a", "b", "na", "nb"), "join-pairs")
    wide = (na > LONG) & (nb > LONG)
    ones = np.array([bin(i).count("1") for i in range(256)], np.int64)
    both = pairs.where(wide)
    for x in ("a", "b"):
        both = both.join(signs.long.select(F.col("key").alias(x), F.col("wide").alias(f"w{x}")), x)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            size = batch.column(2).to_numpy().astype(np.int64) + batch.column(4).to_numpy()
            most = size - 2 * -(-size * percent // (100 + percent))
            keep = []
            for x, y, limit in zip(batch.column(3), batch.column(5), most.tolist(), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                if len(x) != len(y):  # the longer is folded to the length of the shorter
                    x, y = (np.bitwise_xor.reduce(z.reshape(-1, min(len(x), len(y))), axis=0) for z in (x, y))
                keep.append(int(ones[x ^ y].sum()) <= limit)
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.where(~wide).select("a", "b").unionByName(both.select("a", "b", "na", "wa", "nb", "wb").mapInArrow(run, "a long, b long"))


def _common(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Number of common columns of each pair (xs[i], ys[i]) of rows."""
    pair = np.concatenate([np.repeat(np.arange(len(side)), [len(r) for r in side]) for side in (xs, ys)])
    with np.errstate(over="ignore"):
        cell = np.concatenate([*xs, *ys]) + mix(pair.astype(np.uint64) + np.uint64(1))
    order = np.argsort(cell)
    cell, pair = cell[order], pair[order]
    return np.bincount(pair[1:][(cell[1:] == cell[:-1]) & (pair[1:] == pair[:-1])], minlength=len(xs))


def linked(xs: list[np.ndarray], ys: list[np.ndarray], percent: int, column_blocks: int = COLUMN_BLOCKS) -> np.ndarray:
    """Whether each pair (xs[i], ys[i]) of sorted sets links, by overlap counts summed over blocks of columns."""
    edges = np.array([(i << 64) // column_blocks for i in range(1, column_blocks)], np.uint64)
    cuts = [[np.concatenate([[0], np.searchsorted(r, edges), [len(r)]]) for r in side] for side in (xs, ys)]
    size = np.array([[len(r) for r in side] for side in (xs, ys)], np.int64).reshape(2, -1)
    needed = -(-size.sum(axis=0) * percent // (100 + percent))
    count, live = np.zeros(len(xs), np.int64), np.arange(len(xs))
    for j in range(column_blocks):
        if not len(live):
            break
        of = [[rows[i][at[i][j]:at[i][j + 1]] for i in live.tolist()] for rows, at in zip((xs, ys), cuts, strict=True)]
        count[live] += _common(*of)
        rest = [min(len(xs[i]) - cuts[0][i][j + 1], len(ys[i]) - cuts[1][i][j + 1]) for i in live.tolist()]
        live = live[count[live] + np.array(rest, np.int64) >= needed[live]]
    out = np.zeros(len(xs), bool)
    out[live] = True
    return out


def _verify(pairs: DataFrame, signs: _Signs, sets: _Sets, percent: int) -> DataFrame:
    """The pairs (a, b) whose overlap makes a link."""
    pairs = materialize(_plausible(pairs, signs, percent), "join-pairs")
    if pairs.isEmpty():
        return pairs
    have = sets.of(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct())
    both = pairs.join(have.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a").join(have.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [[np.frombuffer(x.as_buffer(), np.uint64) for x in part.column(i)] for i in (2, 3)]
                yield pa.record_batch([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(linked(*rows, percent)))

    return materialize(both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"), "join-links")


def _few(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side of known, bounded size; else leave the choice to Catalyst."""
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


def components(links: DataFrame) -> DataFrame:
    """key, c (smallest key reachable) of every key in ``links`` (a, b).

    Each round takes the least label among neighbours and then the label of the label, until nothing changes.
    """
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "join-edges")
    rows = edges.count()
    parts = 1 + rows // 200_000  # label files follow the number of links
    label = materialize(edges.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("c")).coalesce(parts), "join-labels")
    while True:
        near = (edges.join(_few(label.select(F.col("key").alias("b"), F.col("c").alias("m")), rows), "b")
                .groupBy(F.col("a").alias("key")).agg(F.min("m").alias("m")))
        new = near.join(_few(label, rows), "key").select("key", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        over = label.select(F.col("key").alias("c"), F.col("c").alias("m"))
        new = materialize(new.join(_few(over, rows), "c").select("key", "old", F.least("c", "m").alias("c")).coalesce(parts), "join-labels")
        label = new.select("key", "c")
        if new.where("c <> old").isEmpty():
            return label


def merge(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (key, c) after further ``links``: only edges between its components are walked.

    Many links between two components are one edge, links inside a component are none;
    a key that ``label`` lacks is a component of its own.
    """
    rows = label.count()
    edges = links.select("a", "b")
    for side in ("a", "b"):
        of = label.select(F.col("key").alias(side), F.col("c").alias("of"))
        edges = edges.join(_few(of, rows), side, "left").withColumn(side, F.coalesce("of", side)).drop("of")
    over = components(edges.where("a <> b"))
    new = over.join(label.select("key"), "key", "left_anti")
    known = label.join(over.select(F.col("key").alias("c"), F.col("c").alias("m")), "c", "left").select("key", F.coalesce("m", "c").alias("c"))
    return materialize(known.unionByName(new).coalesce(1 + rows // 200_000), "join-labels")


def _useful(entries: DataFrame, possible, percent: int) -> DataFrame:
    """Rows of the lists that can link, each with the row before it (p_key, p_n, p_left).

    A list of two rows is one pair, which the first round decides: it stays as its second row (``two``), if the
    bounds allow the pair.  In longer lists, in order of size, a row goes whose neighbours are both beyond its bounds,
    as all rows past them are.  A salted list may go on under another salt: all its rows stay.  Repeated entries of one class go.
    """
    order = Window.partitionBy("token", "salt").orderBy("n", "key")
    entries = entries.withColumns({"p_key": F.lag("key").over(order), "p_n": F.lag("n").over(order), "p_left": F.lag("left").over(order),
                                   "x_n": F.lead("n").over(order), "third": F.coalesce(F.lag("n", 2).over(order), F.lead("n", 2).over(order))})
    n, left, salted = F.col("n"), F.col("left"), F.col("salt") >= 0
    middle = F.col("p_key").isNotNull() & F.col("x_n").isNotNull()
    two = ~salted & F.col("third").isNull() & ~middle
    smaller = F.col("p_n") * 100 >= n * percent
    larger = (n * 100 >= F.col("x_n") * percent) & (left >= _needed(n, F.col("x_n"), percent))
    pair = possible(F.col("p_n"), F.col("p_left"), n, left)
    keep = F.when(salted, True).when(two, pair).otherwise(smaller | larger)
    again = F.coalesce(F.col("p_key") == F.col("key"), F.lit(False))
    return entries.withColumn("two", two).where(F.coalesce(keep, F.lit(False)) & ~again).drop("x_n", "third", "salt")


def jaccard_components(docs: DataFrame, k: int = WORDS, percent: int = SIMILARITY, hot: int = HOT, split: int = SPLIT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document row."""
    of = _classes(docs, k, percent, hot, split)
    return of.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _classes(docs: DataFrame, k: int, percent: int, hot: int = HOT, split: int = SPLIT) -> DataFrame:
    """doc_id, n_shingles, key, c, component_id of every document row: its class, the component of that, the component's smallest doc_id."""
    profile = materialize(_profile(docs, k), "join-profile")
    members = profile.where("part is null").drop("part", "counts")
    levels, usual = _levels(profile)

    def possible(na: Column, la: Column, nb: Column, lb: Column) -> Column:
        return (F.least(la, lb) >= _needed(na, nb, percent)) & (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent)

    lists = materialize(_useful(_first_block(docs, levels, usual, k, percent, hot), possible, percent), "join-lists")
    sets = _Sets(docs, members, k)
    signs = _Signs.of(members)

    label = None
    for step in range(LINEAR_ROUNDS):
        if step == 0:
            near = lists.where("p_key is not null").select(F.col("p_key").alias("a"), F.col("key").alias("b"), F.col("p_n").alias("na"),
                                                           F.col("p_left").alias("la"), F.col("n").alias("nb"), F.col("left").alias("lb"))
        else:
            # one row per component of a list: each meets the row before it, and that of the list's largest component
            rows = _multi(lists.where(~F.col("two")) if step == 1 else lists, label)
            lists = rows.select("token", "key", "n", "left")
            pick = F.struct(F.xxhash64("key", F.lit(step)).alias("h"), "key", "n", "left")
            lead = rows.groupBy("token", "c").agg(F.min(pick).alias("x"), F.count("*").alias("m")).select("token", "m", "x.h", "x.key", "x.n", "x.left")
            around, first = (Window.partitionBy("token").orderBy(*o) for o in (("n", "h", "key"), (F.desc("m"), "h", "key")))
            lead = lead.withColumn("before", F.lag(F.struct("key", "n", "left")).over(around)).withColumn(
                "top", F.first(F.struct("key", "n", "left")).over(first))
            near = lead.select(F.explode(F.array("before", "top")).alias("o"), "key", "n", "left").where("o is not null and o.key <> key").select(
                F.col("o.key").alias("a"), F.col("key").alias("b"), F.col("o.n").alias("na"), F.col("o.left").alias("la"), F.col("n").alias("nb"),
                F.col("left").alias("lb"))
        near = near.where(possible(F.col("na"), F.col("la"), F.col("nb"), F.col("lb")))
        found = _verify(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), signs, sets, percent)
        if step and found.isEmpty():
            break
        label = merge(label, found) if step else components(found)
    rows = _multi(lists, label)
    big = rows.groupBy("token", "c").agg(F.count("*").alias("m")).groupBy("token").agg(
        F.max_by("c", F.struct("m", "c")).alias("big"), F.ceil(F.sum("m") / split).cast("int").alias("parts"))
    # two rows that also share the column before this one have met there, under bounds that are no tighter
    rows = rows.withColumn("before", F.lag("token").over(Window.partitionBy("key").orderBy(F.desc("left"))))
    rows = rows.join(big, "token").join(signs.short.select("key", *_SIGNATURE), "key").withColumn("minor", F.col("c") != F.col("big")).drop("big")
    rows = materialize(rows, "join-rest")
    # a long list is cut into parts; its rows outside the largest component meet every part
    a = rows.where("minor").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).alias("a")
    b = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).alias("b")
    na, nb = F.col("a.n"), F.col("b.n")
    joined = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.c") != F.col("b.c")) & (~F.col("b.minor") | (F.col("a.key") < F.col("b.key")))
                    & ~F.coalesce(F.col("a.before") == F.col("b.before"), F.lit(False))
                    & possible(na, F.col("a.left"), nb, F.col("b.left")) & (_differ("a.", "b.") <= na + nb - 2 * _needed(na, nb, percent)))
    pairs = joined.select(F.least("a.key", "b.key").alias("a"), F.greatest("a.key", "b.key").alias("b")).distinct()
    found = _verify(pairs, signs, sets, percent)
    label = merge(label, found)
    of = members.select("doc_id", "key", F.col("n").cast("long").alias("n_shingles")).join(label, "key", "left").withColumn("c", F.coalesce("c", "key"))
    of = materialize(of, "join-members")
    least = of.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return of.join(least, "c", "left")


def _multi(lists: DataFrame, label: DataFrame) -> DataFrame:
    """token, key, n, left, c of the lists that hold more than one component."""
    known = label.count()
    rows = lists.select("token", "key", "n", "left").join(_few(label, known), "key", "left").withColumn("c", F.coalesce("c", "key"))
    if known > BROADCAST_IDS:  # a broadcast join is cheaper to repeat than to store
        rows = materialize(rows, "join-labelled")
    mixed = rows.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token")
    return materialize(rows.join(mixed, "token", "left_semi"), "join-mixed")


def _with_keys(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with the class key of each text (null: no shingles) as ``__key``."""
    text = [c.lower() for c in rows.columns].index("text")

    def run(batches):
        import pyarrow as pa

        for part, texts in _batches(batches, text):
            keys = [_set_key(s) if len(s) else None for _, s in shingle_sets(texts, k)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.int64())], names=[*part.schema.names, "__key"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("__key", LongType())]))


def one_per_component(docs: DataFrame, k: int = WORDS, percent: int = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component, one with the component's smallest doc_id.

    Rows are told apart by their texts where the doc_id does not: of rows under one doc_id, or without one, those in
    different components all stay, and those of one component are one row (the least by class and text hash).  Rows
    without shingles all stay.
    """
    found = materialize(_classes(docs, k, percent), "join-components")
    twice = materialize(found.where("doc_id is not null").groupBy(F.col("doc_id").alias("__twice")).count().where("count > 1").select("__twice"),
                        "join-twice")
    # doc_ids of one row each: those that are not the least of their component go
    gone = found.where("doc_id <> component_id").join(twice, F.col("doc_id") == F.col("__twice"), "left_anti").select(F.col("doc_id").alias("__gone"))
    gone = materialize(gone, "join-gone")
    doc_id = F.col("doc_id").cast("long")
    plain = docs.join(_few(gone, gone.count()), doc_id == F.col("__gone"), "left_anti")
    unclear = docs.where("doc_id is null")
    many = not twice.isEmpty()
    if many:
        plain = plain.join(twice, doc_id == F.col("__twice"), "left_anti")
        unclear = unclear.unionByName(docs.join(twice, doc_id == F.col("__twice"), "left_semi"))
    elif found.where("doc_id is null").isEmpty():
        return plain
    plain = plain.where("doc_id is not null")
    classes = found.where("key is not null").select(F.col("key").alias("__key"), F.col("c").alias("__c"), F.col("component_id").alias("__least"))
    rows = _with_keys(unclear, k).join(classes.distinct(), "__key", "left")
    first = rows.where("__key is not null").where(doc_id.eqNullSafe(F.col("__least")))
    one = first.groupBy("__c").agg(F.min_by(F.struct(*docs.columns), F.struct("__key", F.xxhash64("text"))).alias("__row")).select("__row.*")
    return plain.unionByName(one).unionByName(rows.where("__key is null").select(*docs.columns))

"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing.

Vectors are scaled by the largest norm and given one more component so that all have
norm 1; the nearest in Euclidean distance is then the one with the largest inner
product.  A table hashes a vector with ``K`` functions ``floor((a.x + b) / w)``, a normal
(2-stable).  A query visits, besides its own bucket, buckets with some coordinates
moved by one, in the order of the estimated probability that a neighbour lies
there (nearer bucket bounds first), ``probes`` per table.  The candidates of all tables are
merged and ranked by their exact inner product in double precision.

``K``, the width and ``probes`` come from a grid: of the settings that reach ``TARGET`` recall between
at most ``SAMPLE_QUERIES`` queries and ``SAMPLE`` vectors (smallest hashes of vec_id), against
brute force, the one with the least work at the table's size (the share of rows it visits there, times the rows, and
``VISIT`` rows for each bucket), so a larger table gets smaller buckets and more probes.  Where none reaches it, every query is
answered by the scan of all rows.  Every vector is indexed.

Defined results: vectors that are null, zero, or hold null or non-finite components take no
part, nor do rows with a null vec_id or a length other than the most frequent
(ties: the longer); of rows with one vec_id the smallest vector counts; equal
scores go to the smaller vec_id; a query that finds fewer than ``k`` candidates in its
buckets is answered by a scan of all rows, in blocks; an empty table gives no rows;
other columns are ignored.

Scale: rows are dealt by bucket into parts of about ``PART`` vectors, and each part
ranks its own candidates, so no (query, candidate) row leaves a task but the ``k``
best.  A bucket with more than ``HOT`` rows (or 1/100,000 of all, which bounds
the list of such buckets) is split by vec_id into several parts, and its queries visit all.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silverline.session import materialize

TABLES = 8
#: functions of a table: more of them make smaller buckets, which need more probes
FUNCTIONS = (12, 16)
WIDTHS = (2.5, 3.5, 5.0)
PROBES = (16, 32, 64, 128, 256, 384, 512, 768, 1024)
TARGET = 0.95
SAMPLE, SAMPLE_QUERIES = 16_384, 256
#: cost of a visited bucket in ranked rows
VISIT = 8
PART, HOT = 32_768, 4_096


def valid_vectors(table: DataFrame) -> DataFrame:
    """vec_id and v (array of float) of the rows that take part."""
    v = F.col("embedding")
    fine = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0").where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).where(F.exists("v", lambda x: x != 0))
    fine = materialize(fine.groupBy("vec_id").agg(F.min("v").alias("v")), "ann-vectors")
    sizes = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return fine.where(F.size("v") == (sizes[0]["d"] if sizes else 0))


def probe_sets(k: int, most: int) -> list[tuple[int, ...]]:
    """Sets of ranks among the 2k sorted distances to bucket bounds, by rising expected squared distance; rank r and its
    mirror 2k-1-r are the two sides of one coordinate and never go together."""
    j, m = np.arange(1, 2 * k + 1), 2 * k
    up = m + 1 - j
    cost = np.where(j <= k, j * (j + 1) / (4.0 * (k + 1) * (k + 2)),
                    1 - up / (k + 1.0) + up * (up + 1) / (4.0 * (k + 1) * (k + 2)))
    out, heap = [()], [(cost[0], (0,))]
    while heap and len(out) < most:
        c, s = heapq.heappop(heap)
        if not any(m - 1 - r in s for r in s):
            out.append(s)
        r = s[-1]
        if r + 1 < m:
            heapq.heappush(heap, (c - cost[r] + cost[r + 1], (*s[:-1], r + 1)))
            heapq.heappush(heap, (c + cost[r + 1], (*s, r + 1)))
    return out


class Hashing:
    """The functions of all tables for vectors of dimension ``d`` with largest norm ``norm``; ``exact``: buckets are not to be trusted."""

    def __init__(self, d: int, norm: float, width: float, probes: int, k: int = FUNCTIONS[0], seed: int = 10):
        rng = np.random.default_rng(seed)
        self.norm, self.width, self.probes, self.k, self.exact = norm, width, probes, k, False
        self.a = rng.standard_normal((TABLES, d + 1, k))  # projections of unit vectors have variance 1
        self.b = rng.uniform(0, width, (TABLES, k))
        self.step = rng.integers(1, 1 << 62, (TABLES, k), dtype=np.int64) | 1
        sets = probe_sets(k, probes)
        self.member = np.zeros((len(sets), 2 * k), np.int64)
        for i, s in enumerate(sets):
            self.member[i, list(s)] = 1

    def places(self, t: int, v: np.ndarray, query: bool) -> np.ndarray:
        length = np.linalg.norm(v, axis=1, keepdims=True)
        unit = v / (length if query else self.norm)
        rest = np.zeros_like(length) if query else np.sqrt(np.maximum(0, 1 - (length / self.norm) ** 2))
        return (np.concatenate([unit, rest], axis=1) @ self.a[t] + self.b[t]) / self.width

    def keys(self, t: int, v: np.ndarray) -> np.ndarray:
        """Bucket of every vector."""
        with np.errstate(over="ignore"):
            return (np.floor(self.places(t, v, False)).astype(np.int64) * self.step[t]).sum(axis=1) + t

    def visits(self, t: int, v: np.ndarray) -> np.ndarray:
        """Buckets that every query visits, in estimated success order (queries x probes)."""
        p = self.places(t, v, True)
        cell = np.floor(p)
        near = np.concatenate([p - cell, 1 - (p - cell)], axis=1)  # distance to the lower and the upper bound
        order = np.argsort(near, axis=1, kind="stable")
        move = np.where(order < self.k, -1, 1) * self.step[t][order % self.k]
        with np.errstate(over="ignore"):
            return (cell.astype(np.int64) * self.step[t]).sum(axis=1)[:, None] + t + move @ self.member.T


def fit(vectors: DataFrame, k: int, total: int) -> Hashing | None:
    """Choose functions, width and probes for ``total`` vectors on a bounded sample against brute force."""
    norms = vectors.select(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("n"), F.size("v").alias("d"))
    top = norms.agg(F.max("n").alias("n"), F.max("d").alias("d")).first()
    if top["n"] is None:
        return None
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # bounded
    v = np.array([r["v"] for r in rows], float)
    q = v[:SAMPLE_QUERIES]
    score = q @ v.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    best = np.argsort(-score, axis=1, kind="stable")[:, :min(k, len(v) - 1)]
    d, norm, cost, chosen = int(top["d"]), float(top["n"]), np.inf, None
    for functions in FUNCTIONS:
        for width in WIDTHS:
            h = Hashing(d, norm, width, PROBES[-1], functions)
            first = np.full(best.shape, PROBES[-1])  # first probe that reaches each true neighbour, in any table
            visited = np.zeros(PROBES[-1])  # rows of the sample in the buckets of each probe, over all tables, a query
            for t in range(TABLES):
                keys, visits = h.keys(t, v), h.visits(t, q)
                stored = np.sort(keys)
                visited[:visits.shape[1]] += (np.searchsorted(stored, visits, "right") - np.searchsorted(stored, visits, "left")).mean(axis=0)
                for i in range(len(q)):
                    hit = visits[i][:, None] == keys[best[i]][None]
                    first[i] = np.minimum(first[i], np.where(hit.any(axis=0), hit.argmax(axis=0), PROBES[-1]))
            for probes in PROBES:
                if not best.size or (first < probes).mean() >= TARGET:
                    work = visited[:probes].sum() / len(v) * total + VISIT * TABLES * probes
                    if work < cost:
                        cost, chosen = work, Hashing(d, norm, width, probes, functions)
                    break
    if chosen is None:
        chosen = Hashing(d, norm, WIDTHS[-1], 1)
        chosen.exact = True
    return chosen


def _mix(key: np.ndarray, sub: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = key.view(np.uint64) + np.asarray(sub, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def _vectors(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def inner_products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with ``q``, each summed in one order, so that equal vectors score alike wherever they stand."""
    return (v * q).sum(axis=1)


def _best(rows: list, query: int, ids: np.ndarray, v: np.ndarray, at: np.ndarray, q: np.ndarray, k: int) -> None:
    """Add the ``k`` best of the rows ``at``."""
    near = v[at]
    if len(at) > 4 * k:  # all that can be among them, or tie with the k-th, whatever the rounding of a block product
        rough = near @ q
        slack = 8 * len(q) * np.finfo(float).eps * np.abs(near).max() * np.abs(q).sum()
        keep = rough >= np.partition(rough, len(at) - k)[len(at) - k] - slack
        at, near = at[keep], near[keep]
    score = inner_products(near, q)
    order = np.lexsort((ids[at], -score))[:k]
    rows.append((np.full(len(order), query), ids[at][order], score[order]))


_FOUND = "query_id long, vec_id long, score double"


def _rank(own, asked, k: int):
    """Exact ranking within one part: ``own`` has key, vec_id, v; ``asked`` has query_id, q and keys (none: all rows)."""
    import pyarrow as pa

    rows: list = []
    if own.num_rows and asked.num_rows:
        keys = own.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], own.column("vec_id").to_numpy()[order]
        raw = own.column("v").combine_chunks()
        v = np.frombuffer(b"".join(raw.to_pylist()), np.float64).reshape(len(keys), -1)[order]
        queries = asked.column("query_id").to_numpy()
        for query, qv, visit in zip(queries, asked.column("q").to_pylist(), asked.column("keys").to_pylist(), strict=True):
            q = np.frombuffer(qv, np.float64)
            if visit:
                want = np.unique(np.frombuffer(visit, np.int64))
                lo, hi = np.searchsorted(keys, want, "left"), np.searchsorted(keys, want, "right")
                full = hi > lo
                if not full.any():
                    continue
                lo, hi = lo[full], hi[full]
                n = hi - lo
                at = np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                at = at[np.unique(ids[at], return_index=True)[1]]  # tables merged
            else:
                at = np.unique(ids, return_index=True)[1]
            at = at[ids[at] != query]
            if len(at):
                _best(rows, query, ids, v, at, q, k)
    cols = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(table: DataFrame, is_query: Column, k: int = 20, hot: int = HOT) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every query row (``is_query`` on vec_id)."""
    spark = table.sparkSession
    vectors = materialize(valid_vectors(table), "ann-valid")
    total = vectors.count()
    h = fit(vectors, k, total)
    if h is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    model = spark.sparkContext.broadcast(h)
    parts = max(1, -(-total * TABLES // PART))
    bound = max(hot, -(-total * TABLES // 100_000))

    def bucket_sizes(batches):
        import pyarrow as pa

        for b in batches:
            v = _vectors(b.column(0))
            keys, n = np.unique(np.concatenate([model.value.keys(t, v) for t in range(TABLES)]) if len(v) else np.zeros(0, np.int64), return_counts=True)
            yield pa.record_batch([pa.array(keys), pa.array(n)], names=["key", "n"])

    sizes = vectors.select("v").mapInArrow(bucket_sizes, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > bound)
    split = {r["key"]: -(-r["n"] // bound) for r in sizes.collect()}  # under 100,000 buckets by the bound
    hot_keys = spark.sparkContext.broadcast((np.array(sorted(split), np.int64), np.array([split[x] for x in sorted(split)], np.int64)))

    def subs(keys: np.ndarray) -> np.ndarray:
        known, n = hot_keys.value
        if not len(known):
            return np.ones(len(keys), np.int64)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, n[at], 1)

    def index(batches):
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                ids, v = part.column(0).to_numpy(), _vectors(part.column(1))
                raw = [x.tobytes() for x in v]
                for t in range(TABLES):
                    keys = model.value.keys(t, v)
                    sub = ids.view(np.uint64) % subs(keys).view(np.uint64)
                    yield pa.record_batch([pa.array((_mix(keys, sub) % np.uint64(parts)).astype(np.int32)), pa.array(np.full(len(ids), t, np.int32)),
                                           pa.array(keys), pa.array(ids), pa.array(raw, pa.binary())], names=["part", "t", "key", "vec_id", "v"])

    def visits(batches):
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                rows = b.slice(lo, 256)
                v = _vectors(rows.column(1))
                found = [model.value.visits(t, v) for t in range(TABLES)]
                out: list[tuple] = []
                for i, query in enumerate(rows.column(0).to_pylist()):
                    keys = np.concatenate([f[i] for f in found])
                    n = subs(keys)
                    spread = np.repeat(keys, n)
                    sub = np.arange(len(spread)) - np.repeat(np.cumsum(n) - n, n)
                    to = _mix(spread, sub) % np.uint64(parts)
                    order = np.argsort(to, kind="stable")
                    cuts = np.flatnonzero(np.diff(to[order])) + 1
                    for group in np.split(order, cuts):
                        out.append((int(to[group[0]]), query, v[i].tobytes(), spread[group].tobytes()))
                cols = list(zip(*out, strict=True)) if out else [()] * 4
                yield pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()),
                                       pa.array(cols[3], pa.binary())], names=["part", "query_id", "q", "keys"])

    queries = vectors.where(is_query)
    indexed = vectors.mapInArrow(index, "part int, t int, key long, vec_id long, v binary")
    asked = queries.mapInArrow(visits, "part int, query_id long, q binary, keys binary")

    def rank(own, wanted):
        return _rank(own, wanted, k)

    found = spark.createDataFrame([], _FOUND) if h.exact else indexed.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(rank, _FOUND)
    found = materialize(_top(found, k), "ann-found")
    # queries whose buckets held too few rows: every row, part by part
    short = (queries.select("vec_id", "v").join(found.groupBy("query_id").count(), F.col("vec_id") == F.col("query_id"), "left")
             .where(F.coalesce("count", F.lit(0)) < min(k, total - 1)).select("vec_id", "v"))
    short = materialize(short, "ann-short")
    if not short.isEmpty():
        def everywhere(batches):
            import pyarrow as pa

            for b in batches:
                for query, qv in zip(b.column(0).to_pylist(), _vectors(b.column(1)), strict=True):
                    yield pa.record_batch([pa.array(np.arange(parts, dtype=np.int32)), pa.array([query] * parts, pa.int64()),
                                           pa.array([qv.tobytes()] * parts, pa.binary()), pa.array([b""] * parts, pa.binary())],
                                          names=["part", "query_id", "q", "keys"])

        rest = (indexed.where("t = 0").groupBy("part")
                .cogroup(short.mapInArrow(everywhere, "part int, query_id long, q binary, keys binary").groupBy("part")).applyInArrow(rank, _FOUND))
        late = _top(rest, k)
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(late)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

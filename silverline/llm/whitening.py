"""Embedding whitening: the leading principal components of a table's vectors, found by spectrum slicing.

Entries become integers ``x = floor(256 c)``.  The fit list is each distinct integer vector once; its mean
and covariance are gathered by Spark in exact integers (entries centred to the nearest integer before they are
multiplied, the rest of the mean taken off exactly at the end), so neither depends on how rows lie in partitions.

For the covariance ``V`` the inertia of ``V - s I`` (signs of the pivots of its LDL' factorisation with
Bunch-Kaufman pivoting) counts the eigenvalues above ``s``.  Bisection on that count isolates the k-th largest one,
Rayleigh quotient iteration inside the isolated slice converges cubically, and two more counts, just above and
just below the value found, certify that it is number k.  Where the quotient leaves the slice, bisection goes on;
a slice as narrow as rounding allows holds a cluster, of which any orthonormal basis is taken.

Defined results: rows whose vector is null or holds null or non-finite entries go, and so do vectors of another
length than most of the fit list has (of equal ones the longer; there is none for empty vectors); null and repeated ids stay,
and equal vectors get equal values; entries beyond long saturate; ``deviation`` is null where the exact sum is beyond long; components whose
eigenvalue is 0 (at most ``RANK`` of the largest, or beyond the n - 1 that n vectors span) do not exist, so
a table of equal vectors gives no rows, like an empty one; other columns are not used.

Scale: the only shuffle is that of distinct packed integer vectors; sums leave each task as d (d + 1) / 2
integers that Spark adds up, and the driver holds one d x d matrix whatever the number of rows.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverline.session import materialize

COMPONENTS = 4
#: share of the largest eigenvalue up to which an eigenvalue counts as 0
RANK = 1e-11
#: rows multiplied at a time: with entries below 2^20 all sums stay exact in double precision
ROWS = 8192
_LONG = 2**63 - 1
_EPS = float(np.finfo(float).eps)


# ---- integer vectors inside tasks

def _integers(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of an Arrow list column: row numbers and integer vectors of the rows that take part, by vector length."""
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    flat = column.flatten()
    values = np.asarray(pc.fill_null(flat.cast(pa.float64()), np.nan))
    row = np.repeat(np.arange(len(sizes)), sizes)
    ok = np.bincount(row[~np.isfinite(values)], minlength=len(sizes)) == 0
    begins = np.cumsum(sizes) - sizes
    out = []
    for d in np.unique(sizes[ok & (sizes > 0)]).tolist():
        rows = np.flatnonzero(ok & (sizes == d))
        with np.errstate(over="ignore"):
            x = np.floor(256 * values[begins[rows][:, None] + np.arange(d)])
        far = np.abs(x) >= 2.0**63
        out.append((rows, np.where(far, np.where(x > 0, _LONG, -_LONG), np.where(far, 0, x).astype(np.int64))))
    return out


def _distinct(batches):
    """Packed integer vectors, two bytes an entry where all fit."""
    import pyarrow as pa

    for batch in batches:
        for _, x in _integers(batch.column(0)):
            short = (np.abs(x) < 2**15).all(axis=1)
            packed = [*(r.tobytes() for r in x[short].astype("<i2")), *(r.tobytes() for r in x[~short].astype("<i8"))]
            packed = list(dict.fromkeys(packed))
            yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]] * len(packed), pa.int32()), pa.array(packed, pa.binary())], ["d", "x"])


def _unpacked(batch, d: int):
    """Integer vectors of a batch of packed ones, in blocks of at most ``ROWS``; of one width each."""
    packed = batch.column("x").to_pylist()
    for width in (2, 8):
        mine = [p for p in packed if len(p) == width * d]
        for i in range(0, len(mine), ROWS):
            yield np.frombuffer(b"".join(mine[i:i + ROWS]), f"<i{width}").reshape(-1, d).astype(np.int64)


def _wide(x: np.ndarray, most: int) -> np.ndarray:
    """As Python integers where int64 could overflow."""
    return x.astype(object) if most >= 2**62 else x


def _sums(d: int):
    def run(batches):
        total, n = np.zeros(d, object), 0
        for batch in batches:
            for x in _unpacked(batch, d):
                total += _wide(x, int(np.abs(x).max()) * len(x)).sum(axis=0)
                n += len(x)
        yield _cells([(i, i, total[i]) for i in range(d)] + [(-1, -1, n)])

    return run


def _products(d: int, centre: list[int]):
    def run(batches):
        total = np.zeros((d, d), object)
        for batch in batches:
            for x in _unpacked(batch, d):
                y = _wide(x, max(int(np.abs(x).max()), *map(abs, centre))) - np.array(centre, object if max(map(abs, centre)) >= 2**62 else np.int64)
                if max(abs(int(y.max())), abs(int(y.min()))) < 2**20:
                    y = y.astype(float)
                    total += (y.T @ y).astype(np.int64)
                else:
                    y = y.astype(object)
                    total += y.T @ y
        yield _cells([(i, j, total[i, j]) for i in range(d) for j in range(i, d)])

    return run


def _cells(cells):
    import pyarrow as pa

    i, j, v = zip(*cells, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                       pa.array([Decimal(int(x)) for x in v], pa.decimal128(38, 0))], ["i", "j", "v"])


_CELLS = "i int, j int, v decimal(38,0)"


def _added(cells: DataFrame) -> dict[tuple[int, int], int]:
    """Sums of all tasks: one number for each of the d (d + 1) / 2 cells."""
    return {(r["i"], r["j"]): int(r["v"]) for r in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}


# ---- spectrum slicing

def inertia(a: np.ndarray) -> tuple[int, int, int]:
    """Numbers of negative, zero and positive eigenvalues of a symmetric matrix, from the pivots of its LDL' factorisation."""
    a = np.array(a, float)
    n, k, negative, zero, positive = len(a), 0, 0, 0, 0
    limit = (1 + 17**0.5) / 8
    while k < n:
        size, below = 1, np.abs(a[k + 1:, k])
        most = below.max(initial=0)
        if most > 0 and abs(a[k, k]) < limit * most:
            r = k + 1 + int(below.argmax())
            other = np.abs(a[k:, r]).copy()
            other[r - k] = 0
            across = other.max()
            if abs(a[k, k]) * across < limit * most * most:
                if abs(a[r, r]) < limit * across:
                    size = 2
                to = k + size - 1
                if r != to:
                    a[[to, r], k:] = a[[r, to], k:]
                    a[k:, [to, r]] = a[k:, [r, to]]
        if size == 1:
            pivot = a[k, k]
            negative, zero, positive = negative + (pivot < 0), zero + (pivot == 0), positive + (pivot > 0)
            if pivot != 0:
                c = a[k + 1:, k]
                a[k + 1:, k + 1:] -= np.outer(c / pivot, c)
        else:  # such a block has one eigenvalue of either sign
            negative, positive = negative + 1, positive + 1
            c = a[k + 2:, k:k + 2]
            a[k + 2:, k + 2:] -= c @ np.linalg.solve(a[k:k + 2, k:k + 2], c.T)
        k += size
    return negative, zero, positive


class Spectrum:
    """Leading eigenpairs of a covariance matrix, each certified by counts."""

    def __init__(self, v: np.ndarray):
        self.v, self.d = v, len(v)
        self.norm = float(np.abs(v).sum(axis=1).max(initial=0))
        self.least = 16 * self.d * _EPS * self.norm
        self.probes: dict[float, int] = {-self.norm: self.d, 2 * self.norm: 0}
        self.rng = np.random.default_rng(11)

    def above(self, s: float) -> int:
        """Number of eigenvalues above ``s``."""
        if s not in self.probes:
            self.probes[s] = inertia(self.v - s * np.eye(self.d))[2]
        return self.probes[s]

    def _solve(self, s: float, x: np.ndarray) -> np.ndarray:
        for nudge in (0, 1, 4, 16):
            try:
                y = np.linalg.solve(self.v - (s + nudge * _EPS * self.norm) * np.eye(self.d), x)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(size := np.linalg.norm(y)) and size > 0:
                return y / size
        return x

    def _free(self, x: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
        for _ in range(2):
            for f in found:
                x = x - f * (f @ x)
            x = x / np.linalg.norm(x)
        return x

    def _quotient(self, lo: float, hi: float, found: list[np.ndarray]) -> tuple[float, np.ndarray]:
        """Rayleigh quotient iteration from a vector drawn to the middle of the slice; off the vectors found before."""
        mid = (lo + hi) / 2
        x = self._free(self.rng.normal(size=self.d), found)
        for _ in range(3):
            x = self._free(self._solve(mid, x), found)
        best = (np.inf, 0.0, x)
        for _ in range(12):
            s = float(x @ self.v @ x)
            off = float(np.linalg.norm(self.v @ x - s * x))
            if off >= best[0]:
                break
            best = off, s, x
            if off <= _EPS * self.norm or not lo <= s <= hi:
                break
            x = self._free(self._solve(s, x), found)
        return best[1], best[2]

    def leading(self, count: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Eigenvalues above ``floor`` (falling) and unit vectors (rows), at most ``count``."""
        values, vectors = [], []
        for k in range(1, min(count, self.d) + 1):
            if self.above(floor) < k:
                break
            while True:
                lo = max(s for s, n in self.probes.items() if n >= k)
                hi = min(s for s, n in self.probes.items() if n < k)
                narrow = hi - lo <= self.least
                if narrow or (self.above(lo) == k and self.above(hi) == k - 1):
                    s, x = self._quotient(lo, hi, vectors)
                    if narrow or (lo <= s <= hi and self.above(s + self.least) < k <= self.above(s - self.least)):
                        break
                self.above((lo + hi) / 2)
            values.append(s)
            vectors.append(x if x[np.abs(x).argmax()] > 0 else -x)
        return np.array(values), np.array(vectors).reshape(-1, self.d)


# ---- the table

class Whitener:
    """Fitted mean and components; ``components`` rows are unit eigenvectors."""

    def __init__(self, n: int, sums: list[int], products: dict[tuple[int, int], int], centre: list[int], count: int):
        self.n, self.sums, self.d = n, sums, len(sums)
        rest = [s - n * c for s, c in zip(sums, centre, strict=True)]  # sums of centred entries
        cells = {(i, j): n * v - rest[i] * rest[j] for (i, j), v in products.items()}  # n^2 V, exact
        v = np.zeros((self.d, self.d))
        for (i, j), c in cells.items():
            v[i, j] = v[j, i] = c / (n * n)
        self.trace = sum(cells[i, i] for i in range(self.d)) / (n * n)
        spectrum = Spectrum(v)
        first = spectrum.leading(1, 0.0)[0]
        floor = RANK * float(first[0]) if len(first) else 0.0
        self.values, self.components = spectrum.leading(min(count, n - 1), floor) if self.trace > 0 else (np.zeros(0), np.zeros((0, self.d)))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n x - S``, exact: int64, or Python integers where those could overflow."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        return self.n * _wide(x, most) - np.array(self.sums, object if most >= 2**62 else np.int64)

    def deviation(self, centred: np.ndarray) -> list[int | None]:
        most = max(abs(int(centred.max(initial=0))), abs(int(centred.min(initial=0))))
        whole = centred.astype(object) if most * most * self.d > _LONG else centred
        return [v if v <= _LONG else None for v in (whole * whole).sum(axis=1).tolist()]

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened coordinates; each row is summed in the same order wherever it stands."""
        y = centred.astype(float) / self.n
        return np.stack([(y * c).sum(axis=1) / np.sqrt(e) for c, e in zip(self.components, self.values, strict=True)], axis=1)


def _spread(model: Whitener):
    """Sums of whitened coordinates and of their products over a task's share of the fit list."""
    def run(batches):
        import pyarrow as pa

        k = len(model.values)
        total = np.zeros((k + 1, k))
        for batch in batches:
            for x in _unpacked(batch, model.d):
                w = model.project(model.centred(x))
                total[0] += w.sum(axis=0)
                total[1:] += w.T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    return run


def _whitened(model: Whitener, error: float):
    def run(batches):
        import pyarrow as pa

        k = len(model.values)
        share = model.values / model.trace
        for batch in batches:
            for rows, x in _integers(batch.column(1)):
                if x.shape[1] != model.d:
                    continue
                centred = model.centred(x)
                n = len(rows) * k
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()),
                     pa.array(np.full(n, model.n), pa.int64()), pa.array([v for v in model.deviation(centred) for _ in range(k)], pa.int64()),
                     pa.array(model.project(centred).ravel()), pa.array(np.tile(share, len(rows))), pa.array(np.full(n, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def fit(vectors: DataFrame, embedding: str = "embedding", count: int = COMPONENTS) -> tuple[Whitener | None, float]:
    """The fitted model of a table of vectors and its measured identity error; no model where no vector takes part or all are equal."""
    fit_list = materialize(vectors.select(embedding).mapInArrow(_distinct, "d int, x binary").distinct(), "whitening-fit")
    lengths = fit_list.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths:
        return None, 0.0
    d = lengths[0]["d"]
    fit_list = fit_list.where(F.col("d") == d).select("d", "x")
    sums = _added(fit_list.mapInArrow(_sums(d), _CELLS))
    n = sums.pop((-1, -1))
    totals = [sums[i, i] for i in range(d)]
    centre = [(2 * s + n) // (2 * n) for s in totals]
    model = Whitener(n, totals, _added(fit_list.mapInArrow(_products(d, centre), _CELLS)), centre, count)
    k = len(model.values)
    if not k:
        return None, 0.0
    spread = np.zeros((k + 1, k))
    for r in fit_list.mapInArrow(_spread(model), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        spread[r["i"], r["j"]] = r["v"] / n
    covariance = spread[1:] - np.outer(spread[0], spread[0])
    return model, float(np.abs(covariance - np.eye(k)).max())


def whiten(vectors: DataFrame, embedding: str = "embedding", row_id: str = "vec_id", count: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error): whitened coordinates of every vector that takes part."""
    kind = vectors.schema[row_id].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model, error = fit(vectors, embedding, count)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    return vectors.select(row_id, embedding).mapInArrow(_whitened(model, error), schema)

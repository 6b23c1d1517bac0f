"""Whitening against numpy's eigensolver and exact integer sums."""

import math

import numpy as np
import pytest

from silverline.llm import whitening

KIND = "vec_id long, embedding array<double>, label int, n string"


def table(spark, vectors, parts=3):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x") for i, v in vectors], KIND).repartition(parts)


def brute(vectors):
    d = max((len(v) for _, v in vectors if v), default=0)
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if v and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    y = (n * fit - s).astype(float) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    return good, n, s, e[::-1], u[:, ::-1].T


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(0)
    for d in (1, 2, 3, 7, 40):
        for _ in range(20):
            a = rng.normal(size=(d, d))
            a = a + a.T - np.diag(np.diag(a)) * rng.integers(0, 2)
            e = np.linalg.eigvalsh(a)
            assert whitening.inertia(a) == ((e < 0).sum(), 0, (e > 0).sum())
    assert whitening.inertia(np.zeros((3, 3))) == (0, 3, 0)
    assert whitening.inertia(np.array([[0.0, 1], [1, 0]])) == (1, 0, 1)


@pytest.mark.parametrize("spread", [(9, 8, 7, 6, 5), (5, 5, 5, 5, 5), (5, 5 * (1 + 1e-9), 3, 3, 1), (1e6, 1, 1e-3, 0, 0), (4, 0, 0, 0, 0)])
def test_spectrum_finds_leading_pairs(spread):
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    full = np.concatenate([spread, np.zeros(7)])
    v = (q * full) @ q.T
    v = (v + v.T) / 2
    values, vectors = whitening.Spectrum(v).leading(4, 1e-11 * max(spread))
    want = np.sort(full)[::-1][:4]
    want = want[want > 1e-11 * max(spread)]
    assert len(values) == len(want) and np.allclose(values, want, rtol=1e-9, atol=1e-14 * max(spread))
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12)
    assert np.linalg.norm(v @ vectors.T - vectors.T * values) <= 1e-13 * 12 * np.abs(v).sum()


@pytest.mark.parametrize("parts", [1, 5])
def test_whitening_matches_brute_force(spark, parts):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 9)) @ np.diag([3, 2, 1.5, 1, .5, .4, .3, .2, .1])
    vectors = list(enumerate(base.tolist()))
    vectors += [(1000 + i, base[7].tolist()) for i in range(40)] + [(None, base[8].tolist()), (9, base[9].tolist()), (9, base[9].tolist())]
    vectors += [(2000, None), (2001, []), (2002, [1.0] * 8), (2003, [math.nan] + [0.0] * 8), (2004, [math.inf] + [0.0] * 8), (2005, [None] + [0.0] * 8),
                (2006, [-0.0] * 9), (2007, [0.001] * 9), (2008, [-0.001] * 9)]
    got = whitening.whiten(table(spark, vectors, parts)).collect()
    good, n, s, e, u = brute(vectors)
    assert len(got) == 4 * len(good) and {r["n"] for r in got} == {n}
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["component"]) for r in got) == sorted((-1 if i is None else i, c) for i, _ in good for c in (1, 2, 3, 4))
    exact = {}
    for i, x in good:
        centred = [n * a - b for a, b in zip(x, s, strict=True)]
        exact[i] = sum(c * c for c in centred), (np.array(centred, float) / n) @ u[:4].T / np.sqrt(e[:4])
    sign = {}
    for r in got:
        assert r["deviation"] == exact[r["vec_id"]][0]
        want = exact[r["vec_id"]][1][r["component"] - 1]
        if abs(want) > 0.1:
            sign.setdefault(r["component"], math.copysign(1, want * r["whitened"]))
        assert abs(r["whitened"] * sign.get(r["component"], math.copysign(1, want * r["whitened"])) - want) < 1e-9
        assert abs(r["explained"] - e[r["component"] - 1] / e.sum()) < 1e-12 and r["identity_error"] < 1e-9
    same = {(r["component"], r["whitened"]) for r in got if (r["vec_id"] or 0) >= 1000 and (r["vec_id"] or 0) < 2000}
    assert len(same) == 4  # copies get equal values


def test_whitening_of_degenerate_tables(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1, 2]), (2, [1, 2])])).count() == 0  # one distinct vector
    line = whitening.whiten(table(spark, [(i, [i, 2 * i, 3]) for i in range(50)])).collect()
    assert {r["component"] for r in line} == {1} and line[0]["identity_error"] < 1e-9 and abs(line[0]["explained"] - 1) < 1e-12
    far = whitening.whiten(table(spark, [(i, [1e300 if i == 0 else i, i % 3]) for i in range(9)])).collect()
    assert len(far) == 9 * len({r["component"] for r in far}) and all(r["deviation"] is None for r in far)
    for scale in (1e4, 1e7):  # sums inside and beyond long
        vectors = [(i, [i * scale, i % 3]) for i in range(9)]
        good, n, s, _, _ = brute(vectors)
        exact = {i: sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)) for i, x in good}
        got = whitening.whiten(table(spark, vectors)).collect()
        assert {r["vec_id"]: r["deviation"] for r in got} == {i: v if v < 2**63 else None for i, v in exact.items()}

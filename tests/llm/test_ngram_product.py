"""The blocked product of the n-gram join, and which row of a component stays."""

import numpy as np
import pytest

from silverline.llm import ngram_join


@pytest.mark.parametrize("column_blocks", [1, 3, 4, 16])
def test_summed_overlaps_decide_as_whole_sets_do(column_blocks):
    rng = np.random.default_rng(column_blocks)
    xs, ys = [], []
    for _ in range(300):
        pool = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 400)), dtype=np.uint64) * np.uint64(2))
        share = rng.uniform(0.7, 1)
        xs.append(pool[rng.random(len(pool)) < share])
        ys.append(pool[rng.random(len(pool)) < share])
    xs += [xs[0], np.arange(7, dtype=np.uint64), np.array([3], np.uint64), np.zeros(0, np.uint64)]
    ys += [xs[0], np.arange(1, 8, dtype=np.uint64), np.array([4], np.uint64), np.array([4], np.uint64)]
    want = [100 * len(a & b) >= 75 * len(a | b) for a, b in ((set(x.tolist()), set(y.tolist())) for x, y in zip(xs, ys, strict=True))]
    assert 20 < sum(want) < len(want) - 20
    assert ngram_join.linked(xs, ys, 75, column_blocks).tolist() == want
    assert ngram_join.linked([], [], 75, column_blocks).tolist() == []


def test_long_near_copies_link_and_others_do_not(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 5000)]
    near, far = list(base), list(base)
    for at in range(0, 5000, 200):
        near[at] = "x"
    for at in range(0, 5000, 12):
        far[at] = "y"
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in ((4, base), (2, near), (3, far))], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {4: 2, 2: 2, 3: 3}


def test_rows_are_told_apart_by_their_texts(spark):
    rng = np.random.default_rng(11)

    def text(n=80):
        return " ".join(f"w{i}" for i in rng.integers(0, 10**6, n))

    a, b, c, d = text(), text(), text(), text()
    near = " ".join([*a.split()[:-1], "changed"])
    kind = "doc_id long, Text string, lang string"
    rows = [(1, a, "x"), (1, b, "x"), (1, near, "y"),  # one id, two components
            (None, near, "z"), (None, c, "n"), (None, " ".join([*c.split()[:-1], "other"]), "n"),  # near copies without an id
            (5, d, "x"), (5, d, "x"), (7, d, "x"), (8, b, "x"), (None, None, "e"), (None, "", "e"), (6, "", "e")]
    docs = spark.createDataFrame(rows, kind).withColumnRenamed("Text", "text")
    kept = ngram_join.one_per_component(docs)
    assert kept.columns == docs.columns
    got = [tuple(r) for r in kept.collect()]
    texts = [t for _, t, _ in got]
    assert sum(t in (a, near) for t in texts) == 1 and texts.count(b) == 1 and texts.count(d) == 1
    assert sum(t is not None and t.split()[:5] == c.split()[:5] for t in texts) == 1
    assert sorted((i is None, i) for i, t, _ in got if t in (a, near, b, d)) == [(False, 1), (False, 1), (False, 5)]
    assert sum(not t for t in texts) == 3 and len(got) == 7
    plain = docs.where("doc_id in (7, 8)")
    assert sorted(r["doc_id"] for r in ngram_join.one_per_component(plain).collect()) == [7, 8]
    assert ngram_join.one_per_component(docs.limit(0)).count() == 0

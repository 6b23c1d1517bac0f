"""Equal vectors score alike wherever they stand; links through rows without a doc_id hold."""

import numpy as np
from pyspark.sql import functions as F

from silverline.llm import neighbours, ngram_join


def test_equal_vectors_have_equal_inner_products():
    rng = np.random.default_rng(8)
    for n in (5, 17, 64, 333, 5000):
        v = rng.normal(size=(n, 64))
        same = rng.choice(n, 4, replace=False)
        v[same] = v[same[0]]
        q = rng.normal(size=64)
        for at in (np.arange(n), rng.permutation(n)):
            scores = neighbours.inner_products(v[at], q)
            assert len({scores[np.flatnonzero(at == i)[0]] for i in same}) == 1
            assert np.allclose(scores, v[at] @ q)


def test_equal_vectors_rank_by_id(spark):
    rng = np.random.default_rng(9)
    for n in (30, 47, 211):
        v = rng.normal(size=(n, 16))
        same = rng.choice(n, 6, replace=False)
        v[same] = v[same[0]] * 1.0
        table = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
        got = neighbours.nearest(table, F.col("vec_id") % 20 == 0, k=n).collect()
        for query in {r["query_id"] for r in got}:
            rows = [r for r in got if r["query_id"] == query]
            assert [r["rank"] for r in sorted(rows, key=lambda r: (-r["score"], r["vec_id"]))] == list(range(1, len(rows) + 1))
            ties = [r for r in sorted(rows, key=lambda r: r["rank"]) if r["vec_id"] in set(same.tolist()) - {query}]
            assert len({r["score"] for r in ties}) == 1 and [r["vec_id"] for r in ties] == sorted(r["vec_id"] for r in ties)


def test_queries_are_scanned_where_no_setting_reaches_the_target(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TARGET", 1.1)
    v = np.random.default_rng(11).normal(size=(120, 8))
    table = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(table, F.col("vec_id") % 20 == 0, k=5).collect()
    want = {(i, r, int(j)) for i in range(0, 120, 20) for r, j in enumerate([j for j in np.argsort(-(v @ v[i]), kind="stable") if j != i][:5], 1)}
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == want


def test_links_hold_through_rows_without_an_id(spark):
    rng = np.random.default_rng(10)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 200)]
    a, b, c = words, [*words[:-20], *(f"b{i}" for i in range(20))], [*(f"c{i}" for i in range(20)), *words[20:-20], *(f"b{i}" for i in range(20))]
    texts = [" ".join(x) for x in (a, b, c)]
    sets = [{tuple(x[i:i + 5]) for i in range(len(x) - 4)} for x in (a, b, c)]

    def near(x, y):
        return 100 * len(x & y) >= 75 * len(x | y)

    assert near(sets[0], sets[1]) and near(sets[1], sets[2]) and not near(sets[0], sets[2])
    kind = "doc_id long, text string"
    for ids, want in (((1, 5, 2), {1: 1, 5: 1, 2: 1}), ((1, None, 2), {1: 1, None: 1, 2: 1}), ((1, None, None), {1: 1, None: 1})):
        docs = spark.createDataFrame([*zip(ids, texts, strict=True), (9, "some other words in a text of its own")], kind)
        got = ngram_join.jaccard_components(docs).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want | {9: 9}
    twice = spark.createDataFrame([(1, texts[0]), (1, texts[2]), (None, texts[1]), (1, "entirely different text under the same id")], kind)
    assert {r["component_id"] for r in ngram_join.jaccard_components(twice).collect()} == {1}

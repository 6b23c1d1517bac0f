"""Language-model scoring: base scores against brute force, the model against plain numpy, finite differences and the base score."""

import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from silverline.llm import attention

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def small_model(seed=0, trained=True):
    rng = np.random.default_rng(seed)
    counts = np.zeros(attention.IDS)
    counts[rng.permutation(attention.IDS)[:3000]] = 1e6 / np.arange(1, 3001) ** 1.2
    counts[attention.END] = 500
    model = attention.Model(counts.copy())
    if trained:  # spread the parameters
        for v in model.p.values():
            v += rng.normal(size=v.shape).astype(np.float32) * np.float32(0.05)
    return model, counts


def plain_logs(model, slots):
    """log10 probability of every slot after the first one: one window after the other, one position at a time."""
    p = {k: v.astype(float) for k, v in model.p.items()}
    n, out = len(slots) - 1, {}
    start = 0
    while True:
        x = slots[start:start + attention.WINDOW]
        h = p["ids"][x] + p["places"][:len(x)]
        for i in range(len(x)):
            if start + i in out or start + i >= n:
                continue
            s = (h[:i + 1] @ p["k"]) @ (h[i] @ p["q"]) / np.sqrt(attention.DIM)
            w = np.exp(s - s.max())
            z = h[i] + (w / w.sum()) @ (h[:i + 1] @ p["v"]) @ p["o"]
            o = z + np.maximum(z @ p["in"] + p["in0"], 0) @ p["out"]
            band, member = divmod(int(slots[start + i + 1]), attention.WIDTH)
            logs = []
            for logits, at in ((o @ p["band"] + p["band0"], band), (o @ p["member"][band] + p["member0"][band], member)):
                logs.append(logits[at] - np.log(np.exp(logits).sum()))
            out[start + i] = sum(logs) / np.log(10)
        if start + attention.WINDOW >= n:
            return [out[i] for i in range(n)]
        start += attention.STRIDE


def test_every_id_is_scored_once_in_overlapping_windows():
    model, _ = small_model()
    rng = np.random.default_rng(1)
    lengths = np.array([1, 2, 23, 24, 31, 32, 33, 55, 56, 57, 80, 200, 333])
    begins = np.cumsum(lengths + 1) - lengths - 1
    flat = rng.integers(0, attention.BANDS * attention.WIDTH, (lengths + 1).sum())
    want = [sum(plain_logs(model, flat[b:b + n + 1])) for b, n in zip(begins, lengths, strict=True)]
    assert np.allclose(model.score(flat, begins, lengths), want, rtol=1e-4)


def test_probabilities_sum_to_one():
    model, _ = small_model()
    states = np.random.default_rng(2).normal(size=(1, attention.DIM)).astype(np.float32)
    slots = np.arange(attention.BANDS * attention.WIDTH)
    states = np.repeat(states, len(slots), axis=0)
    logs = model._bands(states, slots)[0] + model._members(states, slots)[0]
    assert abs(np.exp(logs.astype(float)).sum() - 1) < 1e-4
    rest = model.slot == len(slots) - 1
    assert abs((10.0 ** model.share[rest]).sum() - 1) < 1e-9 and (model.share[~rest] == 0).all()


def test_gradients_match_finite_differences():
    model, _ = small_model()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 40, (2, 9)), rng.integers(0, 1024, (2, 9))
    mask = np.ones((2, 9), bool)
    mask[1, 6:] = False
    _, grads = model.gradients(x, y, mask)
    for name, v in model.p.items():
        for at in [tuple(rng.integers(0, n) for n in v.shape) for _ in range(4)] + [np.unravel_index(np.abs(grads[name]).argmax(), v.shape)]:
            old, diff = v[at], []
            for step in (1e-4, -1e-4):
                v[at] = old + step
                diff.append(model.gradients(x, y, mask)[0])
            v[at] = old
            assert abs((diff[0] - diff[1]) / 2e-4 - grads[name][at]) < 2e-4 + 1e-2 * abs(grads[name][at]), name


def batch(rng, n):
    x = rng.integers(0, 1024, (n, attention.WINDOW))
    mask = np.arange(attention.WINDOW) < rng.integers(1, attention.WINDOW + 1, (n, 1))
    return x, np.roll(x, -1, axis=1), mask


def test_gradients_do_not_depend_on_blocks(monkeypatch):
    model, _ = small_model()
    some = batch(np.random.default_rng(6), 50)
    found = []
    for block in (1, 7, 50):
        monkeypatch.setattr(attention, "BLOCK", block)
        found.append(model.gradients(*some))
    for loss, grads in found[1:]:
        assert abs(loss - found[0][0]) < 1e-4 and grads.keys() == model.p.keys()
        assert all(np.allclose(grads[k], found[0][1][k], rtol=1e-3, atol=1e-6) for k in grads)


def test_gradients_work_in_a_cache_not_in_fresh_pages():
    """What a batch's gradients allocate is bounded by a block of windows, not by the batch."""
    model, _ = small_model()
    peak = []
    for n in (128, 1024):
        some = batch(np.random.default_rng(7), n)
        model.gradients(*some)
        tracemalloc.start()
        model.gradients(*some)
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peak[1] < 1.2 * peak[0] and peak[0] < 4 << 20, peak


def test_logits_beyond_the_clip_stay_finite():
    model, _ = small_model()
    for v in model.p.values():
        v *= np.float32(40)
    x, y, mask = batch(np.random.default_rng(8), 20)
    loss, grads = model.gradients(x, y, mask)
    assert np.isfinite(loss) and all(np.isfinite(g).all() for g in grads.values())
    assert np.isfinite(model.score(x.reshape(-1), np.array([0]), np.array([x.size - 1]))).all()


def test_words_in_pieces(monkeypatch):
    for piece in (3, 50, 1 << 20):
        monkeypatch.setattr(attention, "PIECE", piece)
        for text in ("", " ", "Ab  c\x0bD\n", "é" * 40 + " x", " a" * 30, " x y"):
            assert [w.decode() for part in attention.word_pieces(text.encode()) for w in part] == WORD.findall(lower(text))


def test_words_cut_together_like_alone():
    cut = attention._Cutter(attention.TOKENIZER)
    words = ["the", "don't", "a,b;c", "é" * 9, "\u00a0x", "x\u00a0", "\u2003", "12345", "\x1f", "<|endoftext|>", "it's", "\U0001F600", "", "z", "\u3000\u3000"]
    for some in (words, words[:4], words[4:5], [""], []):
        ids, per = cut([w.encode() for w in some])
        want = [cut.encoding.encode_ordinary(" " + w) if w else [attention.END] for w in some]
        assert per.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])


def prose(rng, n):
    return " ".join(("The" if rng.random() < .3 else "x" + "ab"[i % 2]) + str(rng.integers(30)) for i in range(n))


@pytest.mark.parametrize("small", [False, True])
def test_scores_of_a_table(spark, monkeypatch, small):
    monkeypatch.setattr(attention, "FITTED", 600)
    if small:  # many chunks, counters handed on often
        for name, value in (("CHUNK_WORDS", 300), ("CHUNK_DOCS", 7), ("TARGETS", 50), ("TOGETHER", 3), ("COMMON", 4), ("COMMON_BYTES", 3)):
            monkeypatch.setattr(attention, name, value)
    rng = np.random.default_rng(5)
    texts = [prose(rng, int(rng.integers(1, 120))) for _ in range(150)] + [None, "", " \n", "Neverseen", "the " * 70_000, "a b", texts_end := "xa1 " * 3]
    rows = [*enumerate(texts), (None, "The xa1"), (3, texts[3]), (3, texts[3]), (7, texts_end)]
    docs = spark.createDataFrame([(i, t, 1, 2.0) for i, t in rows], "doc_id long, text string, c long, score double").repartition(3)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    got = attention.score(docs, held).collect()
    tokens = [(i, [*WORD.findall(lower(t)), ""], i is None or zlib.crc32(str(i).encode()) % 10 == 0) for i, t in rows]
    c = Counter(w for _, words, out in tokens if not out for w in words)
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, out, len(words), sum(c[w] > 0 for w in words), n,
                   round(sum(np.log10((c[w] + .1) / (n + .1 * (v + 1))) for w in words), 5)) for i, words, out in tokens)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], *list(r[1:5]), round(r["base_score"], 5)) for r in got) == want
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    copies = [r["score"] for r in got if r["doc_id"] == 3]
    assert len(copies) == 3 and max(copies) - min(copies) < 1e-4 * abs(copies[0])
    prose_rows = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 150]
    uniform = -sum(r["n_tokens"] for r in prose_rows) * np.log10(attention.IDS)
    assert sum(r["score"] for r in prose_rows) > uniform  # it has learnt


def test_score_of_empty_and_unlearnt_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert attention.score(docs, F.lit(False)).count() == 0
    got = attention.score(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), F.lit(True)).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert all(r["score"] < 0 for r in got)


def test_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    r = attention.score(docs, held).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > r["b"]


def test_weights_come_from_all_windows(spark, monkeypatch):
    """A start from few windows, all of one kind: what only the other texts show is learnt too."""
    for name, value in (("FITTED", 8), ("ALL_BATCH", 8), ("ALL_RISE", 10)):
        monkeypatch.setattr(attention, name, value)
    cycle = "red green blue white black brown pink grey gold teal".split()
    texts = [" ".join(cycle[(i + j) % 10] for j in range(200)) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    words = attention.count_words(docs)
    model = attention.train(docs, words)
    assert attention.fit_all(docs, model) == 400 * -(-201 // attention.WINDOW)
    r = attention.score(docs, F.col("doc_id") < 5).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > 0.7 * r["b"]  # the next word follows from the last one

"""Quality classifier: Bradley-Terry pairwise ranking on text features.

Every preference pair (a document labelled good, one labelled bad) says that the
first should score higher: ``P(a over b) = sigmoid(w . (f(a) - f(b)))``.  The weights
come from the logistic loss on feature differences.  The cut between the classes
is the one with fewest errors on all labelled documents, each error weighing the
same (from a histogram of their scores, ``STEPS`` to a standard deviation; of equal cuts the middle one);
scores are shifted so that the cut maps to ``THRESHOLD``.

Features are shares and means over the bytes, words and lines of the whole text;
they are counted per buffer in numpy.

Defined results: null and empty texts have all features 0 and get the score of
an empty text; repeated rows score alike; without both labels every document
scores 0.5; a text's score never depends on other columns.

Scale: the weights are learnt from at most ``MOST_LABELLED`` labelled documents of either class
(smallest hashes of doc_id): a documented bound, not a share of the corpus.  The
ids are broadcast (bounded), so the training texts never shuffle.  For the cut all documents
are scored in a narrow pass, and only ids and histogram steps meet the labels.  Scoring
is a narrow pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import blocks, text_bytes

#: bound on the labelled documents of either class that the weights are learnt from
MOST_LABELLED = 8_000
PAIRS = 100_000
THRESHOLD = 0.3
#: histogram steps to a standard deviation of the scores, and standard deviations to either side of their mean
STEPS, REACH = 1000, 20

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "beyond": range(128, 256),
    "space": (32, 9), "line": (10, 13), "stop": (46,), "comma": (44, 59, 58), "exclaim": (33, 63), "bar": (124, 47, 92),
    "mark": (35, 36, 37, 38, 42, 43, 61, 64, 94, 95, 126, 60, 62), "bracket": (40, 41, 91, 93, 123, 125), "quote": (34, 39, 45, 96),
}
_OF_BYTE = np.full(256, len(_CLASSES), np.int64)
for _i, _bytes in enumerate(_CLASSES.values()):
    _OF_BYTE[list(_bytes)] = _i
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
FEATURES = [*_CLASSES, "other", "word_length", "long_words", "short_words", "distinct", "repeat_next", "log_words", "words_per_line",
            "upper_words", "stop_ends", "line_repeats", "mark_ends", "pair_distinct"]


def features(texts: list[bytes]) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    out = np.zeros((len(texts), len(FEATURES)))
    k = len(_CLASSES) + 1
    for b in blocks(texts, _WORD):
        view = np.frombuffer(b.data, np.uint8)
        sizes = np.array([len(t) for t in texts[b.lo:b.hi]])
        begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        length = b.ends - b.starts
        first, last = view[b.starts], view[b.ends - 1]
        inner_upper = _OF_BYTE[view[np.minimum(b.starts + 1, b.ends - 1)]] == 0
        at = 0
        for i, n in enumerate(b.counts.tolist()):
            row, text = out[b.lo + i], view[begins[i]:begins[i] + sizes[i]]
            if not len(text):
                continue
            row[:k] = np.bincount(_OF_BYTE[text], minlength=k) / len(text)
            if n:
                w, ln = slice(at, at + n), length[at:at + n]
                h = b.hashes[w]
                lines = texts[b.lo + i].split(b"\n")
                pairs = h[1:] * np.uint64(3) + h[:-1]
                row[k:] = (min(ln.mean(), 40) / 10, (ln > 14).mean(), (ln < 3).mean(), len(np.unique(h)) / n,
                           (h[1:] == h[:-1]).mean() if n > 1 else 0, np.log1p(n) / 10, np.log1p(n / len(lines)) / 5,
                           ((_OF_BYTE[first[w]] == 0) & (inner_upper[w]) & (ln > 1)).mean(), (last[w] == 46).mean(),
                           1 - len(set(lines)) / len(lines), np.isin(_OF_BYTE[last[w]], (8, 9, 10)).mean(),
                           len(np.unique(pairs)) / (n - 1) if n > 1 else 1)
            at += n
    return out


class Ranker:
    """Scores in 0..1; at least ``THRESHOLD`` means label 1."""

    def __init__(self, good: np.ndarray, bad: np.ndarray, seed: int = 5):
        self.fitted = len(good) > 0 and len(bad) > 0
        if not self.fitted:
            return
        both = np.concatenate([good, bad])
        self.mean, self.spread = both.mean(axis=0), both.std(axis=0) + 1e-3
        g, b = self._scaled(good), self._scaled(bad)
        rng = np.random.default_rng(seed)
        pairs = min(PAIRS, 20 * len(g) * len(b))
        diff = g[rng.integers(0, len(g), pairs)] - b[rng.integers(0, len(b), pairs)]
        self.weights = np.zeros(diff.shape[1])
        for _ in range(25):  # Newton steps on the logistic loss with a small ridge
            p = 1 / (1 + np.exp(np.clip(diff @ self.weights, -30, 30)))
            grad = diff.T @ p / pairs - 1e-3 * self.weights
            curve = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + 1e-3 * np.eye(diff.shape[1])
            step = np.linalg.solve(curve, grad)
            self.weights += step
            if np.abs(step).max() < 1e-8:
                break
        raw = np.concatenate([g, b]) @ self.weights
        self.middle, self.width = float(raw.mean()), max(1e-6, float(raw.std())) / STEPS

    def steps(self, rows: np.ndarray) -> np.ndarray:
        """Histogram step of every row's score; the outermost take what lies beyond."""
        return np.clip(np.floor((self._scaled(rows) @ self.weights - self.middle) / self.width), -REACH * STEPS, REACH * STEPS - 1).astype(np.int32)

    def place_cut(self, good: dict[int, int], bad: dict[int, int]) -> None:
        """Set the cut from the labelled documents of either class by histogram step."""
        low, high = min([*good, *bad]), max([*good, *bad])
        counts = np.zeros((2, high - low + 2), np.int64)
        for row, of in zip(counts, (good, bad), strict=True):
            for step, n in of.items():
                row[step - low + 1] = n
        g, b = counts.cumsum(axis=1)  # below the start of step low + i
        errors = g + b[-1] - b
        best = np.flatnonzero(errors == errors.min())
        self.cut = self.middle + (low + int(best[len(best) // 2])) * self.width
        both, at = counts.sum(axis=0), np.arange(high - low + 2) * self.width
        mean = (both * at).sum() / both.sum()
        self.unit = max(1e-6, float(np.sqrt((both * (at - mean) ** 2).sum() / both.sum())))

    def _scaled(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.spread, -6, 6)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(rows), 0.5)
        z = 4 * (self._scaled(rows) @ self.weights - self.cut) / self.unit + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(np.clip(-z, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Ranker:
    """Learn from the labelled documents in ``labels`` (doc_id, quality): weights from at most ``most`` of either class, the cut from all."""
    spark = docs.sparkSession
    rows = labels.where("quality is not null and doc_id is not null").select(
        F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("int").alias("quality"))
    rows = rows.groupBy("l_id").agg(F.max("quality").alias("quality"))
    order = [F.xxhash64("l_id"), F.col("l_id")]
    chosen = rows.where("quality = 1").orderBy(*order).limit(most).unionByName(rows.where("quality = 0").orderBy(*order).limit(most))
    ids = spark.createDataFrame(chosen.collect(), "l_id long, quality int")  # at most 2 * most rows
    texts = docs.join(F.broadcast(ids), F.col("doc_id").cast("long") == F.col("l_id")).select(
        "l_id", "quality", F.col("text").cast("string").alias("text"))

    def make(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = features(text_bytes(part.column(2)))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(list(rows), pa.list_(pa.float64()))],
                                      names=["l_id", "quality", "f"])

    # one row per chosen id, also where documents repeat
    got = (texts.mapInArrow(make, "l_id long, quality int, f array<double>").groupBy("l_id")
           .agg(F.max("quality").alias("quality"), F.max("f").alias("f")).orderBy("l_id").collect())
    width = len(FEATURES)
    ranker = Ranker(*(np.array([r["f"] for r in got if r["quality"] == q]).reshape(-1, width) for q in (1, 0)))
    if ranker.fitted:
        ranker.place_cut(*_histogram(ranker, docs, rows))
    return ranker


def _histogram(ranker: Ranker, docs: DataFrame, labels: DataFrame) -> list[dict[int, int]]:
    """Number of good and of bad documents in ``labels`` (l_id, quality) by histogram step."""
    known = docs.sparkSession.sparkContext.broadcast(ranker)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.record_batch([part.column(0), pa.array(known.value.steps(features(text_bytes(part.column(1)))))], names=["l_id", "step"])

    thin = docs.select(F.col("doc_id").cast("long").alias("l_id"), F.col("text").cast("string").alias("text")).where("l_id is not null")
    # one row per labelled id, also where documents repeat; at most 2 * REACH * STEPS rows of either class
    got = (thin.mapInArrow(run, "l_id long, step int").join(labels.where("quality in (0, 1)"), "l_id").groupBy("l_id", "quality")
           .agg(F.max("step").alias("step")).groupBy("quality", "step").agg(F.count("*").alias("n")).collect())
    return [{r["step"]: r["n"] for r in got if r["quality"] == q} for q in (1, 0)]


def _apply(ranker: Ranker, docs: DataFrame, at: int, make, schema):
    known = docs.sparkSession.sparkContext.broadcast(ranker)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield make(part, known.value.score(features(text_bytes(part.column(at)))))

    return docs.mapInArrow(run, schema)


def score(ranker: Ranker, docs: DataFrame) -> DataFrame:
    """doc_id, score and predicted of every document."""

    def make(part, scores):
        import pyarrow as pa

        return pa.record_batch([part.column(0), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32))],
                               names=["doc_id", "score", "predicted"])

    return _apply(ranker, docs.select("doc_id", F.col("text").cast("string")), 1, make, "doc_id long, score double, predicted int")


def keep_good(ranker: Ranker, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (all columns) that score at least ``threshold``."""

    def make(part, scores):
        import pyarrow as pa

        return part.filter(pa.array(scores >= threshold))

    return _apply(ranker, docs, [c.lower() for c in docs.columns].index("text"), make, docs.schema)

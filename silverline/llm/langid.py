"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every run of letters is a word, set off by one blank on
either side, and gives the 3-grams of code points around its letters.  Each n-gram
is hashed into one of ``BUCKETS`` buckets.  Learning counts buckets per language
over all given rows; scoring adds up the rows of the smoothed log-probability
matrix for all n-grams of a text, vectorised in numpy, with the matrix broadcast.

Defined results: a null text, or one without letters, is ``und`` with score 0; so
is every text if there is nothing to learn from; a row with null language is
not learnt from; ties go to the language that sorts first; repeated rows
count as often as they occur; other columns are ignored.

Scale: learning is one pass; each task sums its own counts and only (language,
bucket, count) rows move.  The matrix has at most ``MOST_CELLS`` cells,
independent of the corpus: with more languages there are fewer buckets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
#: bound on languages x buckets of the broadcast matrix (float32: 64 MB)
MOST_CELLS = 1 << 24
MIN_SCORE = 0.5
UNKNOWN = "und"
_PIECE = 1 << 18


_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For every code point: is it a letter?"""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def grams(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, text by text, and how many each text has."""
    joined = "\n".join((t or "").lower().replace("\n", " ") for t in texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    del joined
    cut = np.flatnonzero(code == 10)
    letter = _letters()[code]
    c = np.where(letter, code, np.uint32(32)).astype(np.uint64)
    at = np.flatnonzero(letter)
    at = at[at < len(code) - 1]
    before = np.where(at > 0, c[at - 1], np.uint64(32))
    h = ((before * np.uint64(1 << 21) + c[at]) * np.uint64(1 << 21) + c[at + 1]) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64), np.diff(np.searchsorted(at, cut), prepend=0)


def _groups(texts: list[str | None]):
    """(first text, texts) in groups of about ``_PIECE`` characters."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t or "") > _PIECE:
            yield lo, texts[lo:i]
            lo, size = i, 0
        size += len(t or "")
    if lo < len(texts):
        yield lo, texts[lo:]


def _cut_long(texts: list[str | None], longest: int = 4 * _PIECE):
    """Long texts in pieces that end between words where possible: pieces and the text each belongs to."""
    pieces, owner = [], []
    for i, t in enumerate(texts):
        t = t or ""
        at = 0
        while len(t) - at > longest:
            end = t.rfind(" ", at + 1, at + longest)
            end = end if end > at else at + longest
            pieces.append(t[at:end])
            owner.append(i)
            at = end
        pieces.append(t[at:] if at else t)
        owner.append(i)
    return pieces, np.array(owner)


class Model:
    """Languages (sorted) and their log-probabilities by bucket."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts.astype(np.float64) + 0.5
        self.logp = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32).copy() if languages else None
        self.buckets = counts.shape[1]

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        total, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        pieces, owner = _cut_long(texts)
        for lo, group in _groups(pieces):
            h, counts = grams(group, self.buckets)
            used = np.flatnonzero(counts)
            if len(used):
                starts = np.concatenate([[0], np.cumsum(counts)[:-1]])[used]
                sums = np.add.reduceat(self.logp[h], starts, axis=0, dtype=np.float64)
                np.add.at(total, owner[lo + used], sums)
                np.add.at(n, owner[lo + used], counts[used])
        best = total.argmax(axis=1)
        # probability of the best language, with evidence growing as the root of the text's length
        # (n-grams of one text are far from independent)
        z = (total - total[np.arange(len(texts)), best][:, None]) / np.sqrt(np.maximum(n, 1))[:, None]
        p = 1.0 / np.exp(z).sum(axis=1)
        return ([self.languages[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)],
                [float(x) if k else 0.0 for x, k in zip(p, n, strict=True)])


def train(rows: DataFrame, buckets: int = BUCKETS) -> Model:
    """Learn from all rows of ``rows`` (text, lang) that have a language."""
    rows = rows.where(F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().limit(MOST_CELLS // 64 + 1).collect())
    if len(languages) > MOST_CELLS // 64:
        raise ValueError("more languages than the bounded matrix can hold")
    while languages and len(languages) * buckets > MOST_CELLS:
        buckets //= 2
    place = {x: i for i, x in enumerate(languages)}

    def count(batches):
        import pyarrow as pa

        sums = np.zeros((len(languages), buckets), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                pieces, owner = _cut_long(part.column(0).to_pylist())
                lang = np.array([place[x] for x in part.column(1).to_pylist()])[owner]
                for lo, group in _groups(pieces):
                    h, n = grams(group, buckets)
                    key = np.repeat(lang[lo:lo + len(group)], n) * buckets + h
                    sums += np.bincount(key, minlength=sums.size).reshape(sums.shape)
        for i, x in enumerate(languages):
            at = np.flatnonzero(sums[i])
            yield pa.record_batch([pa.array([i] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(sums[i][at], pa.int64())],
                                  names=["lang", "bucket", "n"])

    counts = np.zeros((len(languages), buckets), np.int64)
    if languages:
        got = (rows.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
               .toPandas())  # at most MOST_CELLS cells
        counts[got["lang"], got["bucket"]] = got["n"]
    return Model(languages, counts)


def _predict(model: Model, docs: DataFrame, at: int, make, schema):
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield make(part, *known.value.score(part.column(at).to_pylist()))

    return docs.mapInArrow(run, schema)


def identify(model: Model, docs: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score of every document."""

    def make(part, languages, scores):
        import pyarrow as pa

        return pa.record_batch([part.column(0), pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                               names=["doc_id", "lang_pred", "score"])

    return _predict(model, docs.select("doc_id", F.col("text").cast("string")), 1, make, "doc_id long, lang_pred string, score double")


def keep_identified(model: Model, docs: DataFrame, languages: set[str] | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` (all columns) whose language is known, allowed and found with at least ``min_score``."""

    def make(part, found, scores):
        import pyarrow as pa

        return part.filter(pa.array([x != UNKNOWN and s >= min_score and (languages is None or x in languages)
                                     for x, s in zip(found, scores, strict=True)], pa.bool_()))

    return _predict(model, docs, [c.lower() for c in docs.columns].index("text"), make, docs.schema)

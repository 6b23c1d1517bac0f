"""Source divergence audit against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from silverline.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows, top=200):
    docs = [(lang or "", source or "", TERM.findall(lower(text))) for text, lang, source in rows]
    seen, groups = defaultdict(Counter), defaultdict(dict)
    for lang, source, words in docs:
        groups[lang].setdefault(source, Counter()).update(words)
        seen[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in seen[lang].items() if n >= 3)

        def freq(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        whole, p = freq(sum(sources.values(), Counter())), {s: freq(c) for s, c in sources.items()}
        for s in sources:
            pair = [(sum((p[s][t] - p[h][t]) ** 2 // p[h][t] for t in kept), h) for h in sources if h != s]
            term = [((p[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if sources[s][t] and p[s][t] > whole[t]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, r + 1) for r, (v, item) in enumerate(ranked)]
    return sorted(out)


def rows_of(rng, n=160):
    words = ["the", "The", "a1b", "über", "Éa", "x", "ж", "zz", "o'k", "q_r", "\U0001F600", "tail"]
    rows = []
    for i in range(n):
        k = int(rng.integers(0, 30))
        text = " ".join(rng.choice(words, k, p=(w := np.arange(len(words), 0, -1.0) ** (1 + i % 3)) / w.sum())) if k else None
        rows.append((text, [None, "en", "de"][i % 3], None if i % 7 == 0 else f"s{min(i % 11, 5)}"))
    return [*rows, ("only here", "xx", "a"), (None, "xx", "b"), ("", "xx", None), ("the " * 50_000 + "a" * 9000, "en", "s1"), rows[1], rows[1]]


@pytest.mark.parametrize("small", [False, True])
def test_divergence_matches_brute_force(spark, monkeypatch, small):
    if small:  # several passes, accumulators and counters handed on often, texts in pieces
        for name, value in (("PEERS", 8), ("HELD", 10), ("ENTRIES", 3), ("PIECE", 64)):
            monkeypatch.setattr(divergence, name, value)
    rows = rows_of(np.random.default_rng(3))
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, value int, term string").repartition(3)
    for top in (200, 2):
        got = sorted(tuple(r) for r in divergence.divergence(docs, top=top).collect())
        assert got == brute(rows, top)
    assert {r[4] for r in got if r[0] == "xx"} == {0}


def test_divergence_of_empty_and_textless_tables(spark):
    kind = "text string, lang string, source string"
    assert divergence.divergence(spark.createDataFrame([], kind)).count() == 0
    got = [tuple(r) for r in divergence.divergence(spark.createDataFrame([(None, None, None), (None, None, "b"), ("x", None, "b")], kind)).collect()]
    assert sorted(got) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


def test_frequencies_of_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    c, n, v = 7 * 10**14, 8 * 10**15, 12345
    got = spark.range(1).select(divergence._frequency(F.lit(c), F.lit(n), F.lit(v)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (c + 1) // (n + v)


@pytest.mark.parametrize("piece", [5, 64, 1 << 20])
def test_terms_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(divergence, "PIECE", piece)
    for text in ("", "a", "Ab c9d  über-Ééé x" * 7, "y" * 40, " " * 30, "end " + "é" * 33 + " z"):
        got = [w.decode() for part in divergence.terms(text.encode()) for w in part]
        assert got == TERM.findall(lower(text))

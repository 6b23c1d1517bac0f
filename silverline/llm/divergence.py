"""Source divergence audit: how far the words of each source are from those of its language's other sources.

Every (lang, source) group gives each term that its language keeps a smoothed frequency in
billionths, ``p = 1 + floor(10^9 (count + 1) / (N + V))``.  The audit reports, all in exact integers,

* ``pair``: for each other source of the language ``floor((p - q)^2 / q)`` summed over all kept terms;
* ``term``: the terms that a group uses more than its language does, ``top`` of them by the same value.

Pairs come from Gustavson's row accumulation.  Postings stand term by term (the term-major index);
for a batch of it every group scatters its terms through the index into one dense
accumulator over its peers, so no pair of postings is ever a row.  Terms that one side lacks have the
frequency ``p0`` of a zero count, which does not vanish: with ``f(p, q)`` the value of one term,

    sum over all V terms = V f(p0g, p0h)                                      (both lack it)
        + sum over terms of g of  f(pg, p0h) - f(p0g, p0h)                    (row correction)
        + sum over terms of h of  f(p0g, ph) - f(p0g, p0h)                    (column correction)
        + sum over common terms of f(pg, ph) - f(pg, p0h) - f(p0g, ph) + f(p0g, p0h)

The first three depend on a term through its frequency only, so they are taken once per distinct
frequency.  Accumulators are added up by Spark.

Defined results: null text, lang and source read as ''; empty texts count as documents without terms;
repeated rows are documents of their own; ties rank by the bytes of the item; a
language that keeps no term gives its pairs the value 0; an empty table gives no rows; doc_id and other
columns are not used.  ``value`` is exact while N + V is below 9 * 10^15.

Scale: texts are counted inside tasks, only (lang, source, term) sums move, and a hot source or term is one row a
task.  A task holds one Arrow batch of the index and at most ``HELD`` accumulator entries, which it hands on when full.
The zero frequencies of ``PEERS`` sources of each language are broadcast at a time (8 bytes a source and
language, at most ``PEERS`` a pass in all); more sources take more passes over the index.  The result has a row for each ordered pair of
sources of a language, as its definition asks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silverline.session import materialize

MIN_DOCS = 3
TOP = 200
UNIT = 1_000_000_000
#: (source, term) entries a counting task holds before it hands them on
ENTRIES = 400_000
#: accumulator entries a task holds before it hands them on
HELD = 4_000_000
#: sources whose zero frequencies are broadcast in one pass over the index
PEERS = 1_000_000
#: bytes of a long text that are cut into words at a time
PIECE = 4 << 20

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of one text in order, a bounded piece at a time: runs of letters and of bytes beyond ASCII, A-Z in lower case."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        piece = text[at:end].translate(_WORD_BYTES)
        if end < len(text):
            cut = piece.rfind(b" ")
            while cut < 0 and end < len(text):  # one term longer than a piece
                more = text[end:end + PIECE].translate(_WORD_BYTES)
                cut = more.find(b" ")
                piece, end = piece + more, min(len(text), end + PIECE)
                cut = cut if cut < 0 else len(piece) - len(more) + cut
            if cut >= 0:
                cut = max(cut, 1)
                piece, end = piece[:cut], at + cut
        yield piece.split()
        at = end


def _count(batches):
    """Per task: occurrences and documents of every (lang, source, term)."""
    import pyarrow as pa

    def flush():
        for (lang, source), (tf, df) in tally.items():
            names = list(tf)
            for i in range(0, len(names), 65_536):
                part = names[i:i + 65_536]
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n), pa.array([source] * n), pa.array(part, pa.binary()).cast(pa.string()),
                     pa.array([tf[x] for x in part], pa.int64()), pa.array([df[x] for x in part], pa.int64())], ["lang", "source", "term", "tf", "df"])
        tally.clear()

    tally: dict = {}
    for batch in batches:
        rows = zip(batch.column("text").cast(pa.binary()), batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        for text, lang, source in rows:
            tf, df = tally.setdefault((lang, source), (Counter(), Counter()))
            whole: Counter = Counter()
            for piece in terms(text.as_py()):
                whole.update(piece)
            tf.update(whole)
            df.update(whole.keys())
        if sum(len(tf) for tf, _ in tally.values()) > ENTRIES:
            yield from flush()
    yield from flush()


def _frequency(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(UNIT (count + 1) / (total + kept))``, exact; a group without any kept term reads as one of one."""
    wide = ((count + 1).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")).cast("decimal(38,0)")
    return F.lit(1).cast("long") + F.call_function("floor", _div(wide, F.greatest(total + kept, F.lit(1)).cast("decimal(38,0)"))).cast("long")


def _div(a: Column, b: Column) -> Column:
    """Whole part of a / b for values that are not negative, exact."""
    return (a - F.call_function("mod", a, b)) / b


def gap(p, q):
    """Value of one term: ``floor((p - q)^2 / q)``; int64 arrays or numbers."""
    return (p - q) * (p - q) // q


class Accumulators:
    """Dense accumulators over the peers ``lo ..`` of each group's language; ``zero`` has those peers' zero frequencies by language."""

    def __init__(self, zero: dict[str, np.ndarray], lo: int):
        self.zero, self.lo = zero, lo
        self.held: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        self.size = 0

    def of(self, lang: str, group: int) -> tuple[np.ndarray, np.ndarray]:
        found = self.held.get((lang, group))
        if found is None:
            n = len(self.zero[lang])
            found = self.held[lang, group] = np.zeros(n, np.int64), np.zeros(n, np.int64)
            self.size += 2 * n
        return found

    def start(self, lang: str, group: int, p0: int, kept: int) -> None:
        """Baseline of the terms that both sides lack, as if they lacked all."""
        row, _ = self.of(lang, group)
        row += kept * gap(np.int64(p0), self.zero[lang])

    def add(self, lang: str, sizes: np.ndarray, sid: np.ndarray, p: np.ndarray, p0: np.ndarray) -> None:
        """A batch of the term-major index of one language: ``sizes`` postings a term, each a source with its frequencies."""
        peers = self.zero[lang]
        begins = np.cumsum(sizes) - sizes
        term = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(sid, kind="stable")
        bounds = np.flatnonzero(np.diff(sid[order], prepend=-1, append=-1))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own = order[a:b]  # the group's postings
            group, zero = int(sid[own[0]]), p0[own[0]]
            row, column = self.of(lang, group)
            values, times = np.unique(p[own], return_counts=True)
            step = max(1, 1_000_000 // max(1, len(peers)))
            for i in range(0, len(values), step):
                v, m = values[i:i + step, None], times[i:i + step, None]
                row += (m * (gap(v, peers) - gap(zero, peers))).sum(axis=0)
                column += (m * (gap(peers, v) - gap(peers, zero))).sum(axis=0)
            # scatter: each term of the group reaches the postings of that term
            n = sizes[term[own]]
            ends = np.cumsum(n)
            at = np.arange(ends[-1]) + np.repeat(begins[term[own]] - (ends - n), n)
            pg, ph, zh = np.repeat(p[own], n), p[at], p0[at]
            place = sid[at] - self.lo
            inside = (place >= 0) & (place < len(peers))
            common = gap(pg, ph) - gap(pg, zh) - gap(zero, ph) + gap(zero, zh)
            np.add.at(row, place[inside], common[inside])

    def rows(self):
        import pyarrow as pa

        for (lang, group), (row, column) in self.held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([group], pa.int32()), pa.array([row]), pa.array([column])],
                                             ["lang", "sid", "of_row", "of_column"])
        self.held.clear()
        self.size = 0


_SUMS = "lang string, sid int, of_row array<long>, of_column array<long>"


def _accumulate(zeros, lo: int):
    def run(batches):
        held = Accumulators(zeros.value, lo)
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            lists = batch.column("postings")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            sid, p, p0 = (flat.field(x).to_numpy().astype(np.int64) for x in ("sid", "p", "p0"))
            kinds, of = np.unique(np.array(langs, object), return_inverse=True) if langs else ((), ())
            for k, lang in enumerate(kinds):
                mine = of == k
                own = np.repeat(mine, sizes)
                held.add(lang, sizes[mine], sid[own], p[own], p0[own])
            if held.size > HELD:
                yield from held.rows()
        yield from held.rows()

    return run


def _baseline(zeros, lo: int):
    def run(batches):
        held = Accumulators(zeros.value, lo)
        for batch in batches:
            for x in batch.to_pylist():
                held.start(x["lang"], x["sid"], x["p0"], x["kept"])
                if held.size > HELD:
                    yield from held.rows()
        yield from held.rows()

    return run


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of the audit of ``docs`` (text, lang, source)."""
    empty = F.lit("")
    texts = docs.select(*(F.coalesce(F.col(x), empty).alias(x) for x in ("lang", "source", "text")))
    counts = (texts.mapInArrow(_count, "lang string, source string, term string, tf long, df long")
              .groupBy("lang", "source", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")))
    index = materialize(
        counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("n"), F.collect_list(F.struct("source", "tf")).alias("uses"))
        .where(F.col("df") >= min_docs).drop("df"), "divergence-index")
    uses = index.select("lang", "term", "n", F.inline("uses"))
    languages = index.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    totals = uses.groupBy("lang", "source").agg(F.sum("tf").alias("total"))
    kept, total = F.coalesce("kept", F.lit(0)), F.coalesce("total", F.lit(0))
    groups = materialize(
        texts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(languages, "lang", "left")
        .select("lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("sid"), kept.alias("kept"),
                total.alias("total"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"), _frequency(F.lit(0), total, kept).alias("p0")),
        "divergence-groups")
    postings = uses.join(groups, ["lang", "source"]).select(
        "lang", "term", "source", "sid", "p0", _frequency(F.col("tf"), F.col("total"), F.col("kept")).alias("p"),
        _frequency(F.col("n"), F.col("lang_total"), F.col("kept")).alias("q"))
    return _pairs(postings, groups).unionByName(_terms(postings, top))


def _terms(postings: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return (postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                           F.expr("(p - q) * (p - q) div q").alias("value"))
            .withColumn("rank", rank).where(F.col("rank") <= top))


def _pairs(postings: DataFrame, groups: DataFrame) -> DataFrame:
    spark = groups.sparkSession
    term_major = materialize(postings.groupBy("lang", "term").agg(F.collect_list(F.struct("sid", "p", "p0")).alias("postings")).drop("term"),
                             "divergence-term-major")
    blocks = [(r["lang"], r["n"]) for r in groups.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    # a pass takes a share of every language's sources, PEERS in all
    step = max(1, PEERS // max(1, len(blocks)))
    parts = []
    for lo in range(0, max([0, *(n for _, n in blocks)]), step):
        zeros: dict = {lang: np.zeros(max(0, min(n - lo, step)), np.int64) for lang, n in blocks}
        for r in groups.where((F.col("sid") >= lo) & (F.col("sid") < lo + step)).select("lang", "sid", "p0").toLocalIterator():
            zeros[r["lang"]][r["sid"] - lo] = r["p0"]
        shared = spark.sparkContext.broadcast(zeros)
        sums = term_major.mapInArrow(_accumulate(shared, lo), _SUMS).unionByName(
            groups.select("lang", "sid", "p0", "kept").mapInArrow(_baseline(shared, lo), _SUMS))
        row = sums.select("lang", F.col("sid").alias("g"), F.posexplode("of_row").alias("h", "v")).withColumn("h", F.col("h") + lo)
        column = sums.select("lang", F.col("sid").alias("h"), F.posexplode("of_column").alias("g", "v")).withColumn("g", F.col("g") + lo)
        parts += [row, column.select("lang", "g", "h", "v")]
    if not parts:
        return groups.select("lang", "source", F.lit("pair").alias("part"), F.col("source").alias("item"), F.lit(0).cast("long").alias("value"),
                             F.lit(1).alias("rank")).limit(0)
    both = parts[0]
    for x in parts[1:]:
        both = both.unionByName(x)
    found = both.where("g <> h").groupBy("lang", "g", "h").agg(F.sum("v").alias("value"))
    names = groups.select("lang", "sid", "source")
    named = (found.join(names.withColumnRenamed("sid", "g"), ["lang", "g"])
             .join(names.select("lang", F.col("sid").alias("h"), F.col("source").alias("item")), ["lang", "h"]))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return named.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank)

"""Language-model scoring: a causal self-attention model over subword ids, trained and run in numpy.

A text is its words (A-Z in lower case) and one end; each word is cut into ids of a public byte-level BPE.  The model is
one block of causal self-attention over the last ids and a small feed-forward layer; it gives each next id
a probability in two steps, a band of ids of like frequency and an id of the band.  Ids beyond the
``BANDS * WIDTH - 1`` most frequent ones share one slot and take their share of it by their counts in the whole corpus.

Scoring cuts a text into windows of ``WINDOW`` ids that start every ``STRIDE`` ids.  Attention is
masked and batched over windows; of all windows but the first only the last ``STRIDE`` positions are queried, so every id is
scored once, with ``WINDOW - STRIDE`` to ``WINDOW`` ids before it.

Beside it stands the base score, a word unigram with add-0.1 smoothing over the learnt texts.

Defined results: null and empty texts are one end; rows whose ``held_out`` is null are held out; repeated rows are
documents of their own; with nothing learnt all words are unknown and ids are near uniform; an empty table gives no rows;
other columns are not used.

Scale: words are counted inside tasks and only sums move.  All of it is learnt from the whole corpus: all word counts, from them all
id counts (the frequencies of bands, slots and of ids beyond them), and the network's weights.  These start from a short training on ``FITTED`` windows,
drawn by hash; then every task goes on from there over all windows of its learnt texts, and the weights of the tasks are
averaged by the windows each has seen (summed in Spark, so only one set of weights reaches the driver).  How texts are
dealt to tasks moves the weights a little; texts that are equal score alike in a run.  One more pass scores texts and writes, for each chunk of
documents, one row per distinct word with the documents that hold it; these rows meet the word counts by word and their
documents by chunk, so texts never move and a word is one row a chunk.  Model, id table and the counts of the ``COMMON`` most frequent
words go with the tasks (a fixed bound of a few MB); those words need no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silverline.session import materialize

from .tokens import _encoding

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: ids of the tokenizer, the end among them
IDS, END = 50257, 50256
BANDS, WIDTH = 32, 32
WINDOW, STRIDE = 32, 24
DIM, HIDDEN = 16, 32
#: windows that the weights start from
FITTED = 24_576
EPOCHS, BATCH, RATE = 4, 32, 1.2e-2
#: batches and greatest rate of the pass over all windows, and the batches until it is reached
ALL_BATCH, ALL_RATE, ALL_RISE = 128, 3e-3, 50
#: words and documents of a chunk (documents are numbered in two bytes)
CHUNK_WORDS, CHUNK_DOCS = 1_000_000, 60_000
#: most frequent words whose counts go with the tasks, and their greatest length in bytes: a bound of a few MB
COMMON, COMMON_BYTES = 65_536, 64
#: windows that attention runs on together, and targets whose probabilities are taken together
TOGETHER, TARGETS = 64, 16_384
#: windows whose gradients are taken together
BLOCK = 64
#: bytes of a long text that are cut into words at a time
PIECE = 4 << 20
SMOOTH = 0.1

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = b" \t\n\x0b\x0c\r"


def word_pieces(text: bytes):
    """Words of one text in order, a bounded piece at a time."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end] not in _SPACE:
            after = [x for x in (text.find(s, end, end + PIECE) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x >= 0]
            end = min(after) if after else min(len(text), end + PIECE)
        yield text[at:end].translate(_LOWER).split()
        at = end


# ---- the model

#: scores and logits are held to this size instead of being shifted by their maximum
_MOST = np.float32(60)


def _exp(x: np.ndarray) -> np.ndarray:
    """Exponentials of logits, in place."""
    np.clip(x, -_MOST, _MOST, out=x)
    return np.exp(x, out=x)


def _total(e: np.ndarray) -> np.ndarray:
    """Row sums, one column."""
    return e @ np.ones((e.shape[-1], 1), np.float32)


class _Adam:
    """Steps on parameters ``p``, in place."""

    def __init__(self, p: dict):
        self.p, self.t = p, 0
        dtype = next(iter(p.values())).dtype
        self.first, self.second, self.by = (np.zeros(sum(v.size for v in p.values()), dtype) for _ in range(3))

    def step(self, g: dict, rate: float) -> None:
        self.t += 1
        g, by, at = np.concatenate([g[k].ravel() for k in self.p]), self.by, 0
        self.first += np.float32(0.1) * (g - self.first)
        g *= g
        g -= self.second
        g *= np.float32(0.01)
        self.second += g
        np.sqrt(self.second, out=by)
        by += np.float32(1e-8 * (1 - 0.99**self.t) ** 0.5)
        np.divide(self.first, by, out=by)
        by *= np.float32(rate / (1 - 0.9**self.t) * (1 - 0.99**self.t) ** 0.5)
        for v in self.p.values():
            v -= by[at:at + v.size].reshape(v.shape)
            at += v.size


class Model:
    """Parameters, slots of ids, forward and backward passes."""

    def __init__(self, counts: np.ndarray, seed: int = 13):
        slots = BANDS * WIDTH
        order = np.argsort(-counts, kind="stable")
        top = order[:slots - 1]
        self.slot = np.full(IDS, slots - 1, np.int16)
        self.slot[top] = np.arange(slots - 1)
        rest = counts + SMOOTH
        rest[top] = 0
        self.share = np.zeros(IDS)  # log10 of an id's part of the shared slot
        self.share[rest > 0] = np.log10(rest[rest > 0] / rest.sum())
        self.end = int(self.slot[END])
        mass = np.append(counts[top], counts.sum() - counts[top].sum()).reshape(BANDS, WIDTH) + SMOOTH
        rng = np.random.default_rng(seed)

        def normal(*shape):
            return (rng.normal(size=shape) / np.sqrt(shape[-2] if len(shape) > 1 else 1)).astype(np.float32)

        self.p = {
            "ids": normal(slots, DIM) * np.float32(np.sqrt(slots) * 0.3), "places": normal(WINDOW, DIM) * np.float32(0.3), "q": normal(DIM, DIM), "k": normal(DIM, DIM),
            "v": normal(DIM, DIM), "o": normal(DIM, DIM) * np.float32(0.5), "in": normal(DIM, HIDDEN), "in0": np.zeros(HIDDEN, np.float32),
            "out": normal(HIDDEN, DIM) * np.float32(0.5), "band": normal(DIM, BANDS) * np.float32(0.3),
            "band0": np.log(mass.sum(axis=1) / mass.sum()).astype(np.float32), "member": normal(BANDS, DIM, WIDTH) * np.float32(0.3),
            "member0": np.log(mass / mass.sum(axis=1, keepdims=True)).astype(np.float32),
        }

    def _mixes(self) -> tuple[np.ndarray, np.ndarray]:
        """What queries and keys, values and their output do together: score of two states, and what one adds to the other."""
        p = self.p
        return p["q"] @ p["k"].T * np.float32(DIM**-0.5), p["v"] @ p["o"]

    def _states(self, x: np.ndarray, queried: int, mixes: tuple, ahead: np.ndarray) -> tuple:
        """States of the last ``queried`` positions of windows ``x``, one row each; ``ahead`` is 0 for what lies ahead of a position, else 1."""
        p, (b, n) = self.p, x.shape
        h = p["ids"].take(x, axis=0)
        h += p["places"][:n]
        top = h[:, n - queried:].reshape(-1, DIM)
        q = (top @ mixes[0]).reshape(b, queried, DIM)
        s = _exp(q @ h.transpose(0, 2, 1))
        s *= ahead
        total = _total(s)
        a = s @ h
        a /= total
        z = a.reshape(-1, DIM) @ mixes[1]
        z += top
        f = z @ p["in"]
        f += p["in0"]
        np.maximum(f, 0, out=f)
        out = f @ p["out"]
        out += z
        return h, q, s, total, a, z, f, out

    def _bands(self, states: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray]:
        """Natural log probability of each target's band."""
        p, n, band = self.p, np.arange(len(targets)), targets // WIDTH
        e = states @ p["band"]
        e += p["band0"]
        total = _total(_exp(e))
        return (np.log(e[n, band]) - np.log(total[:, 0]),)

    def _members(self, states: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray]:
        """The same of each target within its band, band by band."""
        p, n = self.p, np.arange(len(targets))
        order = np.argsort(targets.astype(np.int16), kind="stable")
        asked, out = targets.take(order), np.empty(len(targets), states.dtype)
        bounds = np.searchsorted(asked, np.arange(BANDS + 1) * WIDTH)
        sorted_states, member, found = states.take(order, axis=0), asked % WIDTH, np.empty_like(out)
        for b in range(BANDS):
            lo, hi = bounds[b], bounds[b + 1]
            if lo < hi:
                e = sorted_states[lo:hi] @ p["member"][b]
                e += p["member0"][b]
                total = _total(_exp(e))
                found[lo:hi] = np.log(e[n[:hi - lo], member[lo:hi]]) - np.log(total[:, 0])
        out[order] = found
        return (out,)

    def _asked(self, states: np.ndarray, targets: np.ndarray, at: np.ndarray, size: int, both: np.ndarray, grad: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of the natural log probabilities of ``targets`` at rows ``at``, and by all states the gradient of their negated sum over ``size``.

        Every band has one matrix ``both`` for the logits of bands and of its members, its last row for what is added to them;
        their gradients are added to ``grad``.
        """
        order = np.argsort(targets.astype(np.int16), kind="stable")
        asked, n = targets.take(order), len(order)
        bounds = np.searchsorted(asked, np.arange(BANDS + 1) * WIDTH).tolist()
        held = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if lo < hi]
        place = at.take(order)
        own = np.ones((n, DIM + 1), states.dtype)
        own[:, :DIM] = states.take(place, axis=0)
        e = np.empty((n, BANDS + WIDTH), own.dtype)
        for b, lo, hi in held:
            np.matmul(own[lo:hi], both[b], out=e[lo:hi])
        halves = _exp(e).reshape(-1, WIDTH)
        total = _total(halves)
        first = np.arange(0, e.size, BANDS + WIDTH)
        second = first + (BANDS + asked % WIDTH)
        first += asked // WIDTH
        flat = e.reshape(-1)
        log = np.log(flat.take(first)).sum() + np.log(flat.take(second)).sum() - np.log(total).sum()
        total *= size
        halves /= total
        flat[first] -= np.float32(1 / size)
        flat[second] -= np.float32(1 / size)
        back = np.zeros((n + 1, DIM), own.dtype)  # the last row is for positions that are not asked
        turned, across = own.T, both[:, :DIM].transpose(0, 2, 1)
        for b, lo, hi in held:
            part = e[lo:hi]
            grad[b] += turned[:, lo:hi] @ part
            np.matmul(part, across[b], out=back[lo:hi])
        row = np.full(len(states), n)
        row[place] = np.arange(n)
        return float(log), back.take(row, axis=0)

    def gradients(self, x: np.ndarray, targets: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
        """Mean negated log probability of the masked targets and its gradients, summed over blocks of windows that stay in a CPU's cache."""
        p, n, size = self.p, x.shape[1], int(mask.sum())
        g, loss = {k: np.zeros_like(p[k]) for k in ("ids", "places", "in", "in0", "out")}, 0.0
        mixes, ahead = self._mixes(), np.tri(n, dtype=np.float32)
        by = [np.zeros_like(m) for m in mixes]
        both = np.empty((BANDS, DIM + 1, BANDS + WIDTH), p["band"].dtype)
        both[:, :DIM, :BANDS], both[:, DIM, :BANDS], both[:, :DIM, BANDS:], both[:, DIM, BANDS:] = p["band"], p["band0"], p["member"], p["member0"]
        grad = np.zeros_like(both)
        for i in range(0, len(x), BLOCK):
            slots = x[i:i + BLOCK]
            at = np.flatnonzero(mask[i:i + BLOCK])
            h, q, s, total, a, z, f, top = self._states(slots, n, mixes, ahead)
            log, d = self._asked(top, targets[i:i + BLOCK].reshape(-1).take(at), at, size, both, grad)
            loss -= log
            g["out"] += f.T @ d
            df = d @ p["out"].T
            df *= f > 0
            g["in"] += z.T @ df
            g["in0"] += np.ones(len(df), df.dtype) @ df
            dz = df @ p["in"].T
            dz += d
            by[1] += a.reshape(-1, DIM).T @ dz
            da = (dz @ mixes[1].T).reshape(h.shape)
            da /= total
            ds = da @ h.transpose(0, 2, 1)
            ds -= _total(da * a)
            ds *= s
            dh = s.transpose(0, 2, 1) @ da
            dh += ds.transpose(0, 2, 1) @ q
            dq = (ds @ h).reshape(-1, DIM)
            by[0] += h.reshape(-1, DIM).T @ dq
            dh = dh.reshape(-1, DIM)
            dh += dq @ mixes[0].T
            dh += dz
            g["places"][:n] += dh.reshape(h.shape).sum(axis=0)
            flat = slots.astype(np.int16).reshape(-1)
            order = np.argsort(flat, kind="stable")
            flat = flat.take(order)
            begins = np.concatenate([[0], 1 + np.flatnonzero(flat[1:] != flat[:-1])])
            g["ids"][flat.take(begins)] += np.add.reduceat(dh.take(order, axis=0), begins, axis=0)
        scale = np.float32(DIM**-0.5)
        g["q"], g["k"], g["v"], g["o"] = by[0] @ p["k"] * scale, by[0].T @ p["q"] * scale, by[1] @ p["o"].T, p["v"].T @ by[1]
        g["band"], g["band0"] = grad[:, :DIM, :BANDS].sum(axis=0), grad[:, DIM, :BANDS].sum(axis=0)
        g["member"], g["member0"] = grad[:, :DIM, BANDS:], grad[:, DIM, BANDS:]
        return loss / size, g

    def train(self, windows: np.ndarray, seed: int = 17) -> list[float]:
        """Adam over shuffled batches of windows of ``WINDOW + 1`` slots, -1 beyond a text's end; mean loss of every epoch."""
        rng = np.random.default_rng(seed)
        adam, steps, losses = _Adam(self.p), EPOCHS * -(-len(windows) // BATCH), []
        for _ in range(EPOCHS):
            order, loss = rng.permutation(len(windows)), []
            for i in range(0, len(order), BATCH):
                part = windows[order[i:i + BATCH]]
                value, g = self.gradients(np.maximum(part[:, :-1], 0), part[:, 1:], part[:, 1:] >= 0)
                t = adam.t + 1
                adam.step(g, RATE * min(1, t / 20) * (0.05 + 0.95 * (0.5 + 0.5 * np.cos(np.pi * t / steps))))
                loss.append(value)
            losses.append(float(np.mean(loss)))
        return losses

    def score(self, flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 probability of each text: ``lengths`` targets after the end slot at ``begins`` of the slots ``flat``."""
        n = 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
        text = np.repeat(np.arange(len(lengths)), n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out = np.zeros(len(lengths))
        held: list[tuple] = []

        def close():
            states, targets, logs, texts = (np.concatenate(x) for x in zip(*held, strict=True))
            out[:] += np.bincount(texts, logs + self._members(states, targets)[0], len(lengths)) / np.log(10)
            held.clear()

        mixes = self._mixes()
        for later, queried in ((False, WINDOW), (True, STRIDE)):
            ahead = np.tri(queried, WINDOW, WINDOW - queried, dtype=np.float32)
            mine = np.flatnonzero((nth > 0) == later)
            asked = np.s_[:, WINDOW - queried:]
            for i in range(0, len(mine), TOGETHER):
                w = mine[i:i + TOGETHER]
                t, at = text[w], nth[w, None] * STRIDE + np.arange(WINDOW)
                place = begins[t, None] + at
                mask = (at < lengths[t, None])[asked]
                at = np.flatnonzero(mask)
                states = self._states(flat.take(place, mode="clip"), queried, mixes, ahead)[-1].take(at, axis=0)
                targets = flat.take(place[asked].reshape(-1).take(at) + 1, mode="clip")
                held.append((states, targets, self._bands(states, targets)[0], np.repeat(t, mask.sum(axis=1))))
                if sum(len(x[1]) for x in held) >= TARGETS:
                    close()
        if held:
            close()
        return out


# ---- inside tasks

class _Numbered(dict):
    """Numbers keys in order of appearance."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class _Cutter:
    """Ids of distinct words.  Words are joined by spaces and cut together: only an id at a word's start begins with a space."""

    def __init__(self, path: str):
        self.encoding = _encoding(path)
        self.starts = np.zeros(IDS, bool)
        for i in range(self.encoding.n_vocab):
            self.starts[i] = self.encoding.decode_single_token_bytes(i).startswith(b" ")

    def _cut(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.encoding.encode_to_numpy(b"".join(b" " + w for w in words).decode("utf-8", "replace"), disallowed_special=()).astype(np.int32)
        at = np.flatnonzero(self.starts[ids])
        if len(at) == len(words):
            return ids, np.diff(at, append=len(ids))
        if len(words) == 1:  # a word that begins with white space beyond ASCII
            return ids, np.array([len(ids)])
        half = len(words) // 2
        return tuple(np.concatenate(x) for x in zip(self._cut(words[:half]), self._cut(words[half:]), strict=True))

    def __call__(self, words) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order and the number of each word's; the empty word is the end."""
        words = list(words)
        full = [w for w in words if w]
        ids, per = self._cut(full) if full else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        if len(full) < len(words):
            empty = np.array([not w for w in words])
            whole = np.ones(len(words), np.int64)
            whole[~empty] = per
            at = np.cumsum(whole) - whole
            out = np.empty(int(whole.sum()), np.int32)
            ends = np.zeros(len(out), bool)
            ends[at[empty]] = True
            out[ends], out[~ends] = END, ids
            ids, per = out, whole
        return ids, per


class _Chunk:
    """Words of some texts as numbers; number 0 is the end, which stands before and after every text."""

    def __init__(self):
        self.words = _Numbered({b"": 0})
        self.parts: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.rows: list = []

    def add(self, text: bytes, row) -> None:
        end = np.zeros(1, np.int32)
        parts = [end]
        for piece in word_pieces(text):
            parts.append(np.fromiter(map(self.words.__getitem__, piece), np.int32, len(piece)))
        parts.append(end)
        self.sizes.append(sum(map(len, parts)))
        self.parts += parts
        self.rows.append(row)

    def full(self) -> bool:
        return len(self.rows) >= CHUNK_DOCS or sum(self.sizes) >= CHUNK_WORDS

    def ids(self, cut: _Cutter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in order, where each text begins, and how many ids follow its first end."""
        of_word, per = cut(self.words)
        words = np.concatenate(self.parts)
        n = per[words]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat((np.cumsum(per) - per)[words] - (ends - n), n)
        last = ends[np.cumsum(self.sizes) - 1]
        begins = np.concatenate([[0], last[:-1]])
        return of_word[at], begins, last - begins - 1

    def holders(self, common: dict[bytes, int], weigh) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes]]:
        """Known words and base score of each document from the ``common`` words; every other word with its documents: pairs of
        two-byte numbers, document and times."""
        docs = np.repeat(np.arange(len(self.sizes)), self.sizes)
        words = np.concatenate(self.parts)
        keep = np.ones(len(words), bool)
        keep[np.cumsum(self.sizes) - self.sizes] = False  # the end before a text
        pair, times = np.unique(words[keep].astype(np.int64) << 16 | docs[keep], return_counts=True)
        names = list(self.words)
        c = np.fromiter((common.get(w, -1) for w in names), np.int64, len(names))[pair >> 16]
        near, n = c >= 0, len(self.sizes)
        doc = pair[near] & 65_535
        known = np.bincount(doc, times[near] * (c[near] > 0), n).astype(np.int64)
        base = np.bincount(doc, times[near] * weigh(c[near]), n).astype(float)
        pair, times = pair[~near], times[~near]
        split = -(-times // 65_535)
        word, doc = np.repeat(pair >> 16, split), np.repeat(pair & 65_535, split)
        left = np.repeat(times, split) - 65_535 * (np.arange(split.sum()) - np.repeat(np.cumsum(split) - split, split))
        data = np.stack([doc, np.minimum(left, 65_535)], axis=1).astype("<u2").tobytes()
        found, at = np.unique(word, return_index=True)
        at = [*(4 * at).tolist(), len(data)]
        return known, base, [names[i] for i in found.tolist()], [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _weigher(total: int, kinds: int):
    """log10 of the base probability of words with given counts."""
    return lambda c: np.log10((c + SMOOTH) / (total + SMOOTH * (kinds + 1)))


def _texts(batch, *others):
    import pyarrow as pa

    columns = [batch.column(c).to_pylist() for c in others]
    for text, *row in zip(batch.column("text").cast(pa.binary()), *columns, strict=True):
        yield text.as_py() or b"", row


def _count_words(batches):
    import pyarrow as pa

    def flush():
        names = list(tally)
        for i in range(0, len(names), 65_536):
            part = names[i:i + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([tally[w] for w in part], pa.int64())], ["word", "c"])
        tally.clear()

    tally: Counter = Counter()
    for batch in batches:
        for text, _ in _texts(batch):
            for piece in word_pieces(text):
                tally.update(piece)
            tally[b""] += 1
        if len(tally) > CHUNK_WORDS:
            yield from flush()
    yield from flush()


def _count_ids(tokenizer: str):
    def run(batches):
        import pyarrow as pa

        cut, total = _Cutter(tokenizer), np.zeros(IDS, np.int64)
        for batch in batches:
            ids, per = cut(batch.column("word").to_pylist())
            np.add.at(total, ids, np.repeat(batch.column("c").to_numpy(), per))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], ["id", "n"])

    return run


def _drawn(tokenizer: str, rate: float):
    """Windows of learnt texts as raw ids, -1 beyond the end, each kept with probability ``rate`` by its hash."""
    def run(batches):
        import pyarrow as pa

        cut = _Cutter(tokenizer)
        for batch in batches:
            keys, found = [], []
            for text, _ in _texts(batch):
                chunk = _Chunk()
                chunk.add(text, None)
                ids = chunk.ids(cut)[0].astype("<i4")
                for i in range(0, len(ids) - 1, WINDOW):
                    w = ids[i:i + WINDOW + 1]
                    data = np.append(w, np.full(WINDOW + 1 - len(w), -1, "<i4")).tobytes()
                    key = zlib.crc32(data, i & 0xFFFF)
                    if key < rate * 2**32:
                        keys.append(key)
                        found.append(data)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.binary())], ["key", "ids"])

    return run


def _fit_all(shared, tokenizer: str, seed: int):
    """Weights after a pass over all windows of a task's texts, times their number (row ``i`` of all weights in order; row -1: the number)."""
    def run(batches):
        import copy

        import pyarrow as pa

        cut, model, seen = _Cutter(tokenizer), copy.deepcopy(shared.value), 0
        adam, rng = _Adam(model.p), np.random.default_rng(seed)

        def learn(chunk: _Chunk) -> int:
            raw, begins, lengths = chunk.ids(cut)
            slots = model.slot[raw]
            n = -(-lengths // WINDOW)
            text = np.repeat(np.arange(len(n)), n)
            start = WINDOW * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            order = rng.permutation(len(text))
            for i in range(0, len(order), ALL_BATCH):
                part = order[i:i + ALL_BATCH]
                at = start[part, None] + np.arange(WINDOW + 1)
                windows = slots.take(begins[text[part], None] + at, mode="clip").astype(np.int64)
                mask = (at <= lengths[text[part], None])[:, 1:]
                adam.step(model.gradients(windows[:, :-1], windows[:, 1:], mask)[1], ALL_RATE * min(1, (adam.t + 1) / ALL_RISE))
            return len(text)

        chunk = _Chunk()
        for batch in batches:
            for text, _ in _texts(batch):
                chunk.add(text, None)
                if chunk.full():
                    seen += learn(chunk)
                    chunk = _Chunk()
        if chunk.rows:
            seen += learn(chunk)
        if seen:
            flat = np.concatenate([v.ravel() for v in model.p.values()]).astype(float) * seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(flat)), pa.int32()), pa.array(np.append(float(seen), flat))], ["i", "total"])

    return run


def _score_chunks(model: Model, tokenizer: str, shared, weigh):
    """Two kinds of rows for each chunk: its documents (scored) and its less common words (with the documents that hold them)."""
    def run(batches):
        import pyarrow as pa

        cut = _Cutter(tokenizer)

        def done(chunk: _Chunk):
            key = uuid.uuid4().int >> 65
            raw, begins, lengths = chunk.ids(cut)
            share = np.add.reduceat(model.share[raw], begins)
            scores = model.score(model.slot[raw], begins, lengths) + share - model.share[END]
            known, base, words, holders = chunk.holders(common, weigh)
            n = len(chunk.rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * n), pa.array(np.arange(n), pa.int32()), pa.array([r[0] for r in chunk.rows], id_type), pa.array([r[1] for r in chunk.rows]),
                 pa.array(np.array(chunk.sizes) - 1, pa.int64()), pa.array(known), pa.array(base), pa.array(scores), pa.nulls(n, pa.binary()),
                 pa.nulls(n, pa.binary())], names)
            for i in range(0, len(words), 65_536):
                part, m = words[i:i + 65_536], len(words[i:i + 65_536])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * m), pa.nulls(m, pa.int32()), pa.nulls(m, id_type), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
                     pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), pa.array(part, pa.binary()), pa.array(holders[i:i + 65_536], pa.binary())], names)

        names, common = ["chunk", "doc", "doc_id", "held_out", "n_tokens", "known", "base", "score", "word", "holders"], shared.value
        chunk = _Chunk()
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for text, row in _texts(batch, "doc_id", "held_out"):
                chunk.add(text, row)
                if chunk.full():
                    yield from done(chunk)
                    chunk = _Chunk()
        if chunk.rows:
            yield from done(chunk)

    return run


def _base(total: int, weigh):
    """Base score and known words of a chunk's documents: what they have from common words and what its other words add."""
    def run(docs, words):
        import pyarrow as pa

        docs = docs.combine_chunks().sort_by("doc")
        n = docs.num_rows
        words = words.sort_by([("c", "ascending"), ("holders", "ascending")])  # one order of summation, however rows arrive
        holders = words.column("holders").to_pylist()
        c = np.repeat(words.column("c").to_numpy(), [len(h) // 4 for h in holders])
        doc, times = np.frombuffer(b"".join(holders), "<u2").reshape(-1, 2).T.astype(np.int64)
        known = docs.column("known").to_numpy() + np.bincount(doc, times * (c > 0), n).astype(np.int64)
        base = docs.column("base").to_numpy() + np.bincount(doc, times * weigh(c), n)
        return pa.Table.from_arrays([docs.column("doc_id"), docs.column("held_out"), docs.column("n_tokens"), pa.array(known), pa.array(np.full(n, total)),
                                     pa.array(base), docs.column("score")],
                                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


# ---- the corpus

def count_words(docs: DataFrame) -> DataFrame:
    """Rows (word, c) of ``docs.text``; the empty word is the end."""
    return docs.select("text").mapInArrow(_count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def common_words(words: DataFrame) -> dict[bytes, int]:
    """Words with the highest counts, ``COMMON`` at most: whole steps of an eighth of a power of two, so no task sends more than belongs to them."""
    short = words.where(F.octet_length("word") <= COMMON_BYTES).withColumn("step", F.floor(8 * F.log2("c")))
    least, n = None, 0
    for r in sorted(short.groupBy("step").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):
        n += r["n"]
        if n > COMMON:
            break
        least = r["step"]
    return {} if least is None else {bytes(r["word"]): r["c"] for r in short.where(F.col("step") >= least).collect()}


def train(docs: DataFrame, words: DataFrame, tokenizer: str = TOKENIZER, seed: int = 13) -> Model:
    """Fit the model on ``docs`` (text), whose word counts are ``words``."""
    counts = np.zeros(IDS)
    for r in words.mapInArrow(_count_ids(tokenizer), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    model = Model(counts.copy(), seed)
    if counts.sum():
        windows = counts.sum() / WINDOW + counts[END]  # about as many as there are
        rate = min(1.0, 1.2 * FITTED / windows)
        of_texts = min(1.0, 16 * rate)
        bucket = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 20))
        some = docs.where(bucket < int(of_texts * (1 << 20))).select("text")
        drawn = some.mapInArrow(_drawn(tokenizer, rate / of_texts), "key long, ids binary").orderBy("key", "ids").limit(FITTED).collect()
        if drawn:
            raw = np.frombuffer(b"".join(r["ids"] for r in drawn), "<i4").reshape(-1, WINDOW + 1)
            model.train(np.where(raw < 0, -1, model.slot[raw]).astype(np.int64))
        fit_all(docs, model, tokenizer, seed)
    return model


def fit_all(docs: DataFrame, model: Model, tokenizer: str = TOKENIZER, seed: int = 13) -> int:
    """Take ``model`` once over all windows of ``docs`` (text), its weights the mean of the tasks' by their windows; gives the number of windows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    parts = docs.select("text").mapInArrow(_fit_all(shared, tokenizer, seed), "i int, total double")
    total = {r["i"]: r["total"] for r in parts.groupBy("i").agg(F.sum("total").alias("total")).collect()}  # one set of weights
    seen, at = int(total.get(-1, 0)), 0
    if seen:
        for v in model.p.values():
            v[...] = (np.array([total[i] for i in range(at, at + v.size)]) / seen).reshape(v.shape)
            at += v.size
    return seen


def score(docs: DataFrame, held_out: Column, tokenizer: str = TOKENIZER) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of ``docs`` (doc_id, text), learnt from rows not held out."""
    docs = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(True)).alias("held_out"))
    learnt = docs.where(~F.col("held_out"))
    words = materialize(count_words(learnt), "attention-words")
    size = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    weigh = _weigher(size["n"], size["v"])
    model = train(learnt, words, tokenizer)
    shared = docs.sparkSession.sparkContext.broadcast(common_words(words))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = materialize(docs.mapInArrow(_score_chunks(model, tokenizer, shared, weigh),
                                         f"chunk long, doc int, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, "
                                         "word binary, holders binary"), "attention-chunks")
    rows = scored.where("word is null").select("chunk", "doc", "doc_id", "held_out", "n_tokens", "known", "base", "score")
    found = (scored.where("word is not null").select("chunk", "word", "holders").join(words, "word", "left")
             .select(F.col("chunk").alias("of_chunk"), "holders", F.coalesce("c", F.lit(0)).alias("c")))
    return rows.groupBy("chunk").cogroup(found.groupBy("of_chunk")).applyInArrow(
        _base(size["n"], weigh),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

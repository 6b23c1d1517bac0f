"""Vectorised word scanning inside tasks: word bounds and 64-bit word hashes from UTF-8 bytes.

A text is cut at separator bytes; every word gets a polynomial hash over its
(lower-cased, table-mapped) bytes, computed for a whole buffer at once with one
prefix sum.  Both word rules used here separate at ASCII characters only, so
working on UTF-8 bytes is exact.  Texts are processed whole: small ones together
in buffers of about ``CHUNK`` bytes, long ones alone, piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

CHUNK = 1 << 18
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
LOWER = _lower

#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (digits, a-z, everything beyond ASCII) after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: words ``[^\x20\x09-\x0D]+``
NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, 9, 10, 11, 12, 13]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A finalising bijection on uint64 values (shift, multiply, shift)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n:
        n = max(n, CHUNK + (CHUNK >> 1))
        for name, base in (("p", _BASE), ("i", _BASE_INV)):
            steps = np.full(n, base & _MASK, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["p"], _POWERS["i"]


def _scan(buf: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of one buffer."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = is_word[buf]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[LOWER[buf]] * power[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts]), starts, ends


@dataclass
class Block:
    """Words of the texts ``lo .. hi-1``: counts per text, and hashes/starts/ends of all words in order."""

    lo: int
    hi: int
    counts: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: bytes

    def word(self, i: int) -> bytes:
        """Bytes of word ``i`` with A-Z in lower case."""
        return self.data[self.starts[i]:self.ends[i]].lower()


def _long(text: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One long text, scanned in pieces that end at a separator."""
    parts, at, view = [], 0, np.frombuffer(text, np.uint8)
    while at < len(text):
        end, step = min(len(text), at + 4 * CHUNK), 4 * CHUNK
        while end < len(text):
            cut = np.flatnonzero(~is_word[view[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
                break
            step *= 2
            end = min(len(text), at + step)
        h, s, e = _scan(view[at:end], is_word)
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def blocks(texts: list[bytes], is_word: np.ndarray) -> Iterator[Block]:
    """Word blocks covering ``texts`` in order, each text whole within one block."""
    lo, size, n = 0, 0, len(texts)
    for i in range(n + 1):
        if i == n or (i > lo and size + len(texts[i]) > CHUNK):
            if i > lo:
                if i - lo == 1 and len(texts[lo]) > 4 * CHUNK:
                    h, s, e = _long(texts[lo], is_word)
                    yield Block(lo, i, np.array([len(h)]), h, s, e, texts[lo])
                else:
                    data = b" ".join(texts[lo:i])
                    h, s, e = _scan(np.frombuffer(data, np.uint8), is_word)
                    bounds = np.cumsum([len(t) + 1 for t in texts[lo:i]])
                    found = np.searchsorted(s, bounds)
                    yield Block(lo, i, np.diff(found, prepend=0), h, s, e, data)
            lo, size = i, 0
        if i < n:
            size += len(texts[i])


_STEP = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LEN = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words (``len(hashes) - k + 1`` values)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, _LEN[k % 64] + np.uint64(k), np.uint64)
    for j in range(k):
        out += hashes[j:j + n] * _STEP[j % 64]
    return mix(out)


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null reads as empty."""
    import pyarrow as pa

    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]

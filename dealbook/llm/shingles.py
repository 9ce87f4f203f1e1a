"""Distinct word n-gram sets of whole texts, hashed in numpy over byte arrays."""

from __future__ import annotations

import numpy as np

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
# Bytes that separate words: space and 0x09-0x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# A-Z to a-z; all other bytes stay.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
# Bytes that go through the array operations together.
CHUNK = 1 << 18


def _powers(n: int) -> np.ndarray:
    p = np.full(n, np.uint64(0x5851F42D4C957F2D))
    p[0] = 1
    return np.multiply.accumulate(p)


_POWERS = _powers(1 << 12)


def words_of(raw: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, start positions and byte lengths of the words in a byte array; ``fold`` lower-cases A-Z first."""
    none = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    if raw.size == 0:
        return none
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if starts.size == 0:
        return none
    low = _BYTE_HASH[_LOWER[raw] if fold else raw]
    length = ends - starts
    if length.max() < _POWERS.size:
        # Position of each byte in its word picks its multiplier, so equal words hash alike everywhere.
        first = np.zeros(raw.size, dtype=np.int64)
        first[starts] = starts
        np.maximum.accumulate(first, out=first)
        at = np.arange(raw.size) - first
        np.minimum(at, _POWERS.size - 1, out=at)
        low *= _POWERS[at]
        low[space] = 0
        out = np.add.reduceat(low, starts)
    else:
        grow = _powers(int(length.max()))
        out = np.array([(low[s:e] * grow[: e - s]).sum(dtype=np.uint64)
                        for s, e in zip(starts, ends)], dtype=np.uint64)
    return mix(out + length.astype(np.uint64) * _BASE), starts, length


def shingle_sets(texts, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its ``width``-word shingles.

    A text with fewer words gives its whole word sequence as one shingle; a
    null text or one without words gives an empty set.
    """
    out: list[np.ndarray] = []
    texts = list(texts)
    i = 0
    while i < len(texts):
        # Texts go through numpy together, about CHUNK bytes at a time.
        part, size = [], 0
        while i < len(texts) and (not part or size < CHUNK):
            t = texts[i]
            part.append(b"" if t is None else t.encode("utf-8", "surrogatepass"))
            size += len(part[-1])
            i += 1
        out += _sets(part, width)
    return out


def _sets(part: list[bytes], width: int) -> list[np.ndarray]:
    raw = np.frombuffer(b"\n".join(part), dtype=np.uint8)
    words, starts, _ = words_of(raw)
    begins = np.cumsum([0] + [len(p) + 1 for p in part])
    cut = np.searchsorted(starts, begins)
    n = words.size
    grams = np.zeros(n, dtype=np.uint64)
    full = max(0, n - width + 1)
    for k in range(width):
        grams[:full] = grams[:full] * _M1 + words[k: k + full]
    grams = mix(grams + np.uint64(width))
    out = []
    for a, b in zip(cut[:-1], cut[1:]):
        if b - a >= width:
            out.append(np.unique(grams[a: b - width + 1]))
        elif b > a:
            acc = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    acc = acc * _M2 + w
                out.append(mix(np.array([acc + np.uint64(b - a)], dtype=np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out

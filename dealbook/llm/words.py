"""Words of whole texts, unchanged, as hashes and byte positions; rolling hashes and minima over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from dealbook.llm.shingles import _SPACE, words_of

#: Bytes that go through the array operations together; a chunk ends at a space.
CHUNK = 1 << 18
#: Characters of text that a task holds at a time (one text at least).
SLICE_CHARS = 2_000_000
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut to about SLICE_CHARS characters of text each."""
    for pdf in batches:
        part = pdf["text"].str.len().fillna(0).cumsum() // SLICE_CHARS
        for _, rows in pdf.groupby(part.to_numpy(), sort=True):
            yield rows


def _chunk_end(raw: np.ndarray, at: int) -> int:
    """The first space at or after ``at``, or the end."""
    while at < raw.size:
        space = _SPACE[raw[at: at + 4096]]
        k = int(space.argmax())
        if space[k]:
            return at + k
        at += space.size
    return raw.size


class Words:
    """The words of several texts: hash, start and length in ``raw``, and the word range of each text."""

    def __init__(self, texts):
        part = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        self.raw = b"\n".join(part)
        data = np.frombuffer(self.raw, dtype=np.uint8)
        found, at = [], 0
        while at < data.size:
            end = _chunk_end(data, min(data.size, at + CHUNK))
            h, start, length = words_of(data[at:end], fold=False)
            found.append((h, start + at, length))
            at = end
        none = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
        self.hash, self.start, self.length = (np.concatenate(x) for x in zip(none, *found))
        begins = np.cumsum([0] + [len(p) + 1 for p in part])
        #: Words of text k are ``cut[k]`` to ``cut[k + 1]``.
        self.cut = np.searchsorted(self.start, begins)
        self.text = np.repeat(np.arange(len(part)), np.diff(self.cut))

    def __len__(self) -> int:
        return self.hash.size

    def span(self, first: int, last: int) -> bytes:
        """The bytes from word ``first`` to word ``last``, both included."""
        return self.raw[self.start[first]: self.start[last] + self.length[last]]


def ahead(x: np.ndarray, by: int) -> np.ndarray:
    """x moved to the front by so many places; the last places keep the last value."""
    return x if not by or not x.size else np.concatenate((x[by:], np.repeat(x[-1:], min(by, x.size))))


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Order-dependent hashes of ``width`` consecutive values from each place on, by doubling.

    The last ``width`` - 1 places, which have too few values, hold no such hash.
    """
    power, span, out, have = h, 1, None, 0
    while span <= width:
        if width & span:
            out = power if out is None else power * np.uint64(pow(_BASE, have, 1 << 64)) + ahead(out, span)
            have += span
        power = power * np.uint64(pow(_BASE, span, 1 << 64)) + ahead(power, span)
        span *= 2
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of ``width`` consecutive values from each place on, by doubling."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x, ahead(x, span))
        span *= 2
    return np.minimum(x, ahead(x, width - span))

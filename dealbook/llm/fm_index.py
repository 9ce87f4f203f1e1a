"""A compressed index of word sequences: Burrows-Wheeler transform in a wavelet tree.

The suffixes of the indexed sequences are sorted by their first ``depth``
words, which is all that a search for up to ``depth`` words needs: the rows of
a pattern are an interval, and prepending a word maps its bounds through a rank
in the transform.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
#: Packed sort keys hold two ranks and a place of so many bits each.
_PACKED = 21


class BitVector:
    """Bits in 64-bit words with the count of ones before each word: 1.5 bits a bit."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.append(bits, np.zeros(64 - bits.size % 64, bool)), bitorder="little")
        self.words = packed.view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.uint32)
        self.before = (np.cumsum(counts, dtype=np.uint32) - counts).astype(np.uint32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletTree:
    """Rank of any symbol in a sequence: one bit vector a level, zeros stably before ones (a wavelet matrix)."""

    def __init__(self, symbols: np.ndarray, bound: int):
        self.levels: list[BitVector] = []
        self.zeros: list[int] = []
        self.bits = max(1, int(bound - 1).bit_length())
        seq = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            self.levels.append(BitVector(bit))
            self.zeros.append(int(bit.size - np.count_nonzero(bit)))
            seq = np.concatenate((seq[~bit], seq[bit]))
        # Where the places of each symbol begin on the last level.
        self.begin = np.searchsorted(_reversed_order(seq, self.bits), _reversed_order(np.arange(bound), self.bits))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        for level, (vector, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            ones = vector.rank(at).astype(np.int64)
            at = np.where(one, zeros + ones, at - ones)
        return at - self.begin[symbol]


def _reversed_order(x: np.ndarray, bits: int) -> np.ndarray:
    """The bits of x in reverse: the order in which a wavelet matrix leaves the symbols."""
    out = np.zeros_like(x)
    for k in range(bits):
        out |= (x >> k & 1) << (bits - 1 - k)
    return out


def _sorted_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the pairs (a, b), and whether each differs from the one before it."""
    if a.size < 1 << _PACKED and max(int(a.max()), int(b.max())) < 1 << _PACKED:
        key = np.sort((a << 2 * _PACKED) | (b << _PACKED) | np.arange(a.size))
        order, key = key & ((1 << _PACKED) - 1), key >> _PACKED
    else:
        order = np.lexsort((b, a))
        key = a[order] * (int(b.max()) + 1) + b[order]
    fresh = np.ones(a.size, dtype=bool)
    fresh[1:] = key[1:] != key[:-1]
    return order, fresh


def _ranks(order: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    out = np.empty(order.size, dtype=np.int64)
    out[order] = np.cumsum(fresh)  # from 1; 0 stands for "past the end"
    return out


def _later(rank: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(rank)
    if by < rank.size:
        out[: rank.size - by] = rank[by:]
    return out


class FMIndex:
    """Index of a word-number sequence (0 separates documents) for patterns of up to ``depth`` words."""

    def __init__(self, text: np.ndarray, depth: int):
        self.depth = depth
        bound = int(text.max()) + 1
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=bound))))[:bound]
        self.rows, fresh = self._suffixes(text, depth)
        #: Rows that begin an interval of ``depth`` equal words, and of one word less.
        self.begins, self.parents = fresh
        self.tree = WaveletTree(text[self.rows - 1], bound)

    @staticmethod
    def _suffixes(text: np.ndarray, depth: int):
        """Suffix order by the first ``depth`` words, by doubling, and where intervals begin."""
        rank, span = text.astype(np.int64) + 1, 1
        while 2 * span < depth:
            rank = _ranks(*_sorted_pairs(rank, _later(rank, span)))
            span *= 2
        order, fresh = _sorted_pairs(rank, _later(rank, depth - span))
        tail = _later(rank, depth - 1 - span) if depth - 1 > span else rank
        parents = np.ones(order.size, dtype=bool)
        parents[1:] = (rank[order][1:] != rank[order][:-1]) | (tail[order][1:] != tail[order][:-1])
        return order, (fresh, parents)

    def prepend(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """First row of the pattern with the symbol put before it, from the first row of the pattern."""
        return self.counts[symbol] + self.tree.rank(symbol, row)

    def per_interval(self, values: np.ndarray) -> np.ndarray:
        """For every row the least value (by text place) of its interval of ``depth`` equal words."""
        starts = np.flatnonzero(self.begins)
        least = np.minimum.reduceat(values[self.rows], starts)
        return np.repeat(least, np.diff(np.append(starts, self.rows.size)))

    def parent_rows(self) -> np.ndarray:
        """For every row the first row of its interval of ``depth`` - 1 equal words: the parent operation."""
        starts = np.flatnonzero(self.parents)
        return np.repeat(starts, np.diff(np.append(starts, self.rows.size)))


def earliest(text: np.ndarray, first: np.ndarray, length: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Matching statistics of the indexed sequences, asked for ``depth`` words.

    ``text`` holds the sequences (from ``first``, so many words), 0 behind each;
    ``order`` gives every text place where a window begins its rank, others a
    huge one. Sequences stream through the index from right to left, in step:
    a word is put before the pattern, and once the pattern is ``depth`` long,
    its interval tells the least rank among the window's occurrences and the
    parent operation takes the last word off again. All streamed windows lie
    in the index, so an interval's first row is enough. Returns the least rank
    for every text place.
    """
    index = FMIndex(text, depth)
    least, parents = index.per_interval(order), index.parent_rows()
    out = order.copy()
    lanes = np.argsort(-length, kind="stable")
    ends, length = (first + length)[lanes], length[lanes]
    row = np.zeros(lanes.size, dtype=np.int64)
    for step in range(1, int(length.max(initial=0)) + 1):
        live = int(np.searchsorted(-length, -step, "right"))
        place = ends[:live] - step
        row = index.prepend(text[place], row[:live])
        if step >= depth:
            out[place] = least[row]
            row = parents[row]
    return out

"""Whole-text token ids of a byte-level BPE vocabulary, word by word.

The vocabulary's pattern cuts a text into words that are encoded
independently. Words are found with array operations over code points and
looked up by 64-bit keys in a table of known words; only new words go through
the encoder, one by one, and the ids are gathered back.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import numpy as np

VOCABULARY = "byte_bpe_50k"
#: Id that ends every document.
END = 0
#: Code points handled together, and words kept between chunks.
CHUNK = 1 << 18
CACHE_WORDS = 1_000_000

_LETTER, _DIGIT, _SPACE, _OTHER = 0, 1, 2, 3
# The suffixes that the vocabulary's pattern splits off after an apostrophe, and its special token.
_SUFFIXES = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_SPECIAL = "<|endoftext|>"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point under the pattern's letter, number and white-space tests."""
    import regex

    table = np.full(0x110000, _OTHER, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, test in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(test, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if b - a + 1 == len(m[0]):
                table[a: b + 1] = kind
            else:
                table[[ord(c) for c in m[0]]] = kind
    return table


class Encoder:
    """Encodes texts as the tokenizer file does, special token included, without added tokens."""

    def __init__(self, name: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                      special_tokens={_SPECIAL: len(ranks)})
        self._reset()

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self._bpe.encode(text, allowed_special="all"), dtype=np.uint32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text (uint32); none for a null or empty one."""
        out: list[np.ndarray | None] = [None] * len(texts)
        part: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if not text:
                out[i] = np.empty(0, dtype=np.uint32)
            elif _SPECIAL in text or ("'" in text and any(s in text for s in _SUFFIXES)):
                out[i] = self._plain(text)
            else:
                part.append(i)
                size += len(text)
                if size >= CHUNK:
                    self._chunk(texts, part, out)
                    part, size = [], 0
        if part:
            self._chunk(texts, part, out)
        return out

    def _chunk(self, texts, part, out) -> None:
        try:
            text = "".join([texts[i] for i in part])
            code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        except UnicodeEncodeError:  # lone surrogates
            for i in part:
                out[i] = self._plain(texts[i].encode("utf-8", "replace").decode())
            return
        ends = np.cumsum([len(texts[i]) for i in part])
        kind = _classes()[code]
        # A word starts where the class changes and where a text starts.
        start = np.ones(code.size, dtype=bool)
        start[1:] = kind[1:] != kind[:-1]
        first = np.concatenate(([0], ends[:-1]))
        start[first] = True
        # The last white-space character before another class starts a word of its own ...
        last = np.zeros(code.size, dtype=bool)
        last[:-1] = (kind[:-1] == _SPACE) & (kind[1:] != _SPACE)
        last[ends - 1] = False
        start |= last
        # ... and a plain space there leads the word that follows it.
        lead = np.flatnonzero(last & (code == 0x20))
        start[lead + 1] = False
        begin = np.flatnonzero(start)
        length = np.diff(np.append(begin, code.size))
        ids, per_word = self._words(text, code, begin, length)
        token_ends = np.cumsum(per_word)
        word_ends = np.searchsorted(begin, ends, "left") - 1
        cuts = np.concatenate(([0], token_ends[word_ends]))
        for k, i in enumerate(part):
            out[i] = ids[cuts[k]: cuts[k + 1]]

    def _words(self, text, code, begin, length):
        """Ids of all words in order, and the number of ids of each."""
        at = np.arange(code.size, dtype=np.uint64) - np.repeat(begin.astype(np.uint64), length)
        h = (code + at * _M2) * _M1
        h ^= h >> np.uint64(29)
        h *= _M2
        h ^= h >> np.uint64(32)
        keys = (np.add.reduceat(h, begin) + length.astype(np.uint64)) * _M1
        found, back = np.unique(keys, return_inverse=True)
        slot = np.searchsorted(self._keys, found)
        slot[slot == self._keys.size] = 0
        fresh = np.flatnonzero(self._keys[slot] != found)
        if fresh.size:
            if self._keys.size > CACHE_WORDS:
                self._reset()
                fresh = np.arange(found.size)
            pick = np.empty(found.size, dtype=np.int64)
            pick[back] = np.arange(begin.size)
            pick = pick[fresh]
            encode = self._bpe._core_bpe.encode_ordinary
            lists = [encode(text[a:b]) for a, b in zip(begin[pick].tolist(), (begin + length)[pick].tolist())]
            self._learn(found[fresh], lists)
            slot = np.searchsorted(self._keys, found)
        slot = slot[back]
        per_word = self._counts[slot]
        step = np.repeat(self._offsets[slot] - (np.cumsum(per_word) - per_word), per_word)
        return self._ids[np.arange(step.size) + step], per_word

    def _reset(self) -> None:
        self._keys = np.array([np.iinfo(np.uint64).max], dtype=np.uint64)
        self._counts = np.zeros(1, dtype=np.int64)
        self._offsets = np.zeros(1, dtype=np.int64)
        self._ids = np.empty(0, dtype=np.uint32)

    def _learn(self, keys: np.ndarray, lists: list[list[int]]) -> None:
        """Adds words (sorted keys) to the table of known ones."""
        counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        flat = np.array(list(chain.from_iterable(lists)), dtype=np.uint32)
        at = np.searchsorted(self._keys, keys)
        self._offsets = np.insert(self._offsets, at, self._ids.size + np.cumsum(counts) - counts)
        self._counts = np.insert(self._counts, at, counts)
        self._keys = np.insert(self._keys, at, keys)
        self._ids = np.concatenate((self._ids, flat))


@lru_cache(maxsize=2)
def encoder(name: str = VOCABULARY) -> Encoder:
    """One encoder per worker process."""
    return Encoder(name)

"""Runs of periodic words, from a suffix automaton with link-cut access.

A run is a stretch of words with smallest period q (words q apart are equal)
that no neighbouring word extends. The automaton of a text has a node for every
set of end positions; its suffix links form a tree in which the path from a
prefix's node to the root holds all suffixes of that prefix. Words are appended
one by one: access to the new prefix's path recolours it with the new position,
and each stretch of the path with one old colour e tells that the suffix of its
greatest length l occurred last at e. With d = i - e <= l the two occurrences
meet or overlap, which is a square of period d: the l + d words up to i have
smallest period d and cannot be extended to the left. Followed over i, these
are exactly the runs.

Paths are kept as in a link-cut tree's access operation: heavy paths of the
link tree, each with a stack of coloured stretches whose top stretch is
nearest the root, so an access pops what it covers and costs O(log n) amortised.

Only stretches that can hold a run go through the automaton: inside a run of
period q every pair of words after the first q + 1 has an equal pair at most q
before it. That test works on arrays, for all periods between two powers of two
together, and loses no run.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealbook.llm.common import small_batches
from dealbook.llm.shingles import mix
from dealbook.llm.words import Words, rolled, slices

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
_NEVER = np.iinfo(np.int64).max


class SuffixAutomaton:
    """Automaton of a sequence of hashable words; ``prefix[i]`` is the node of its first i + 1 words."""

    def __init__(self, words):
        self.length, self.link, step = [0], [-1], [{}]
        self.prefix = []
        length, link, last = self.length, self.link, 0
        for word in words:
            node = len(length)
            length.append(length[last] + 1)
            link.append(0)
            step.append({})
            self.prefix.append(node)
            at = last
            while at >= 0 and word not in step[at]:
                step[at][word] = node
                at = link[at]
            if at >= 0:
                to = step[at][word]
                if length[to] == length[at] + 1:
                    link[node] = to
                else:
                    twin = len(length)
                    length.append(length[at] + 1)
                    link.append(link[to])
                    step.append(step[to].copy())
                    while at >= 0 and step[at].get(word) == to:
                        step[at][word] = twin
                        at = link[at]
                    link[to] = link[node] = twin
            last = node

    def heavy_heads(self) -> list[int]:
        """The top node of the heavy path of each node of the link tree."""
        n = len(self.link)
        by_length = np.argsort(np.array(self.length), kind="stable").tolist()
        size, heavy = [1] * n, [-1] * n
        for v in reversed(by_length[1:]):
            up = self.link[v]
            size[up] += size[v]
            if heavy[up] < 0 or size[v] > size[heavy[up]]:
                heavy[up] = v
        head = list(range(n))
        for v in by_length[1:]:
            if heavy[self.link[v]] == v:
                head[v] = head[self.link[v]]
        return head


def runs_of(words, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """All runs of a word sequence as (start, length, period), by start and period.

    ``least_periods`` is 2 or more.
    """
    automaton = SuffixAutomaton(words)
    length, link, head = automaton.length, automaton.link, automaton.heavy_heads()
    stacks: list[list[tuple[int, int]]] = [[] for _ in length]
    ends: dict[tuple[int, int], int] = {}
    for i, node in enumerate(automaton.prefix):
        colour = -1
        while node > 0:
            stack, depth = stacks[head[node]], length[node]
            met = []
            while stack and stack[-1][0] <= depth:
                met.append(stack.pop())
            if stack and (not met or met[-1][0] < depth):
                met.append((depth, stack[-1][1]))
            stack.append((depth, i))
            for long, e in reversed(met):
                # Of the stretches with one colour the deepest has the whole common suffix.
                if e != colour:
                    colour = e
                    d = i - e
                    if long + d >= least_periods * d and long + d >= least_words:
                        ends[i - long - d + 1, d] = i
            node = link[head[node]]
    return sorted((s, e - s + 1, d) for (s, d), e in ends.items())


def _pair_distance(words: Words) -> np.ndarray:
    """For every word, how far back the pair of it and the word before it occurred last in the same text.

    Keys are cut to the bits that sort together with the place; a clash can only make a distance smaller.
    """
    n = len(words)
    out = np.full(n, _NEVER)
    if n < 2:
        return out
    pair = np.flatnonzero(words.text[1:] == words.text[:-1]) + 1
    key = mix(rolled(words.hash, 2)[pair - 1] + mix(words.text[pair].astype(np.uint64)))
    bits = np.uint64(n.bit_length())
    both = np.sort((key >> bits << bits) | pair.astype(np.uint64))
    key, at = both >> bits, (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    same = key[1:] == key[:-1]
    out[at[1:][same]] = (at[1:] - at[:-1])[same]
    return out


def candidates(words: Words, least_words: int = LEAST_WORDS,
               least_periods: int = LEAST_PERIODS) -> list[tuple[int, int]]:
    """Disjoint word ranges [a, b) that hold every run with the words beside it, each within one text."""
    distance = _pair_distance(words)
    longest = int(np.diff(words.cut).max(initial=0))
    found, most = [], 1
    far = np.flatnonzero(distance > most)
    while True:
        # Periods from `least` to `most`: a run has so many pairs in a row with an equal one at most `most` before.
        least = most // 2 + 1
        need = max(least_words, least_periods * least) - least - 1
        if need > longest:
            break
        edge = np.concatenate(([-1], far, [len(words)]))
        hit = np.flatnonzero(np.diff(edge) > need)
        found.append(np.column_stack((edge[hit] + 1 - most - 2, edge[hit + 1] + 1, edge[hit] + 1)))
        most *= 2
        far = far[distance[far] > most]
    rows = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    if not rows.size:
        return []
    # The first pair of a text has no distance, so a range belongs to the text of its first pair.
    text = words.text[rows[:, 2]]
    a, b = np.maximum(rows[:, 0], words.cut[text]), np.minimum(rows[:, 1], words.cut[text + 1])
    order = np.argsort(a, kind="stable")
    out: list[tuple[int, int]] = []
    for x, y, t in zip(a[order].tolist(), b[order].tolist(), text[order].tolist()):
        if out and x < out[-1][1] and words.text[out[-1][0]] == t:
            out[-1] = (out[-1][0], max(out[-1][1], y))
        else:
            out.append((x, y))
    return out


def runs_of_texts(texts, least_words: int = LEAST_WORDS,
                  least_periods: int = LEAST_PERIODS) -> list[list[tuple[int, int, int]]]:
    """The runs of each text."""
    words = Words(texts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b in candidates(words, least_words, least_periods):
        text = int(words.text[a])
        shift = a - int(words.cut[text])
        found = runs_of(words.raw[words.start[a]: words.start[b - 1] + words.length[b - 1]].split(),
                        least_words, least_periods)
        out[text] += [(s + shift, n, q) for s, n, q in found]
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without those that a run contains after its first period."""
    gone = set()
    for start, length, period in runs:
        gone.update(range(start + period, start + length))
    return [w for i, w in enumerate(words) if i not in gone] if gone else words


def _found(batches: Iterator[pd.DataFrame], least_words: int, least_periods: int) -> Iterator[pd.DataFrame]:
    for pdf in slices(batches):
        texts = pdf["text"].tolist()
        runs = runs_of_texts(texts, least_words, least_periods)
        kept = [b" ".join(collapse([] if t is None else t.encode("utf-8", "surrogatepass").split(), r))
                .decode("utf-8", "surrogatepass") for t, r in zip(texts, runs)]
        yield pd.DataFrame({
            "doc_id": pd.array(pdf["doc_id"].tolist(), dtype="Int64"),
            "runs": [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs],
            "collapsed": kept})


def find_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS,
              prepare: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None) -> DataFrame:
    """Runs of every document and its text without the repeated periods.

    Returns doc_id, runs (array of start word, length in words, period; by
    start and period) and collapsed (the words that no run contains after its
    first period, joined by one space), one row per row of ``docs``. That needs
    doc_id and text; other columns are ignored. ``prepare`` may rewrite the
    batches first. Words are separated by space and 0x09-0x0D and otherwise
    unchanged. A null, empty or blank text has no run and collapses to an empty
    text; a null doc_id stays null; repeated rows each get their row; an empty
    table gives an empty one. Texts are whole at any length: what goes through
    the automaton grows with the periodic stretches only.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        return _found(prepare(batches) if prepare else batches, least_words, least_periods)

    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_loops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A tenth of the documents, by the checksum of their id, go round in their own words from some word on.

    A null doc_id or a text without words stays as it is.
    """
    for pdf in batches:
        texts = pdf["text"].tolist()
        for k, doc_id in enumerate(pdf["doc_id"].tolist()):
            if texts[k] is None or pd.isna(doc_id):
                continue
            h = zlib.crc32(str(int(doc_id)).encode())
            if h % 10:
                continue
            words = texts[k].encode("utf-8", "surrogatepass").split()
            n, g = len(words), h // 10
            if n:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words[a:] = [words[a + (i - a) % p] for i in range(a, n)]
                texts[k] = b" ".join(words).decode("utf-8", "surrogatepass")
        yield pdf.assign(text=texts)


def run_digests(docs: DataFrame) -> DataFrame:
    """The runs of the documents after ``with_loops``: their count, the one of greatest exponent, and digests.

    Handling of odd rows is that of ``find_runs``.
    """
    found = find_runs(docs, prepare=with_loops)
    # The greatest exact length / period by cross products; ties to the smallest start, then period.
    best = F.expr("""aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (b, r) ->
        case when b is null or r.length * b.period > b.length * r.period then r else b end)""")
    lines = F.expr("""concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))""")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))

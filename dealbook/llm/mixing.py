"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic) that hold tokens. Topics are
learned: spherical k-means on the hashed long words of all documents, each of
which goes to the nearest centre. Raking
scales the cells' token weights until the shares of every source, language and
topic meet their targets. The calibrated weight of a cell, divided by the
largest one, is the probability with which each of its documents is sampled,
so the expected token shares of the sample are the targets.

One small cell of large weight would make that sample tiny. Where it falls
short of a stated share of the tokens, the sample gets that share: values and
cells that the targets ask more of than they hold are kept whole, and the
others are fitted anew to what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealbook.llm.common import small_batches, written
from dealbook.llm.shingles import CHUNK, words_of

TOPICS = 8
#: Only words of at least this many bytes speak for a topic, by their hash to so many places.
TOPIC_WORD_BYTES, TOPIC_PLACES = 6, 1024
#: Rounds of k-means at most.
TOPIC_ROUNDS = 20
#: A place of a text and how many of its words have it; terms that a task takes at a time.
TERM, BLOCK_TERMS = np.dtype([("place", "<u2"), ("count", "<u4")]), 50_000
#: Texts whose terms are laid out in full rows at a time; cosines as near to each other as this are taken anew.
FULL_ROWS, CLOSE = 256, 1e-9
#: Cosines and unit rows in whole numbers are so many times larger; tasks that add up the sums of the others.
SCALE, SUM_TASKS = 1 << 30, 4
#: Languages with a target of their own, the ones of most tokens; all others share one (OTHER) in the fit.
LANGUAGES, OTHER = 24, "*"
#: Target share of a value: its token share to this power, normalised. Below 1 lifts the rare ones.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
TOLERANCE = 1e-9
MAX_SWEEPS = 200
SEED = 17
#: The query's and the pipeline's sample keeps at least this share of the tokens.
KEPT_SHARE = 0.5
#: Of the fit with cells kept whole: relative error of the languages and topics, and sweeps at most.
CAPPED_TOLERANCE, CAPPED_SWEEPS = 1e-6, 30


def _parts(texts) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in parts of about CHUNK bytes: how many, and of their words the hash, the length and the text."""
    values = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    i = 0
    while i < len(values):
        j, size = i, 0
        while j < len(values) and (j == i or size < CHUNK):
            size += len(values[j])
            j += 1
        words, starts, length = words_of(np.frombuffer(b"\n".join(values[i:j]), dtype=np.uint8))
        ends = np.cumsum([len(p) + 1 for p in values[i:j]])
        yield j - i, words, length, np.searchsorted(ends, starts, "right")
        i = j


def _term_counts(n: int, words: np.ndarray, length: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Counts of the hashed long words of n texts."""
    long = length >= TOPIC_WORD_BYTES
    place = (words[long] % np.uint64(TOPIC_PLACES)).astype(np.int64)
    return np.bincount(doc[long] * TOPIC_PLACES + place, minlength=n * TOPIC_PLACES).reshape(n, -1)


def _found_terms(part: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts of a part as sparse counts: number of terms of each text, places (ascending) and counts."""
    counts = _term_counts(*part).ravel()
    at = np.flatnonzero(counts)
    return np.bincount(at // TOPIC_PLACES, minlength=part[0]), at % TOPIC_PLACES, counts[at]


#: Logarithms of the common counts.
_DAMPED = np.log1p(np.arange(1 << 12))


def _damped(count: np.ndarray) -> np.ndarray:
    return _DAMPED[count] if count.size and count.max() < _DAMPED.size else np.log1p(count)


class Topics:
    """Weights of the places and centres (unit rows); without centres every text has topic 0."""

    def __init__(self, weights: np.ndarray, centres: np.ndarray):
        self.weights, self.centres = weights, centres

    def of(self, size: np.ndarray, place: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Topics of texts by their terms: how many each has, places and counts; without terms topic 0."""
        own = np.zeros(size.size, np.int32)
        if len(self.centres) and (some := size > 0).any():
            first = (np.cumsum(size) - size)[some]
            own[some] = _nearest(first, place, _damped(count) * self.weights[place], self.centres)
        return own


def _counted(text: str) -> Column:
    """struct(n_tokens, terms) of a text column: words, and places of the long ones with their counts (TERM records)."""
    @F.pandas_udf(T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("terms", T.BinaryType())]))
    def column(texts: pd.Series) -> pd.DataFrame:
        counts, terms = [np.empty(0)], []
        for part in _parts(texts.tolist()):
            counts.append(np.bincount(part[3], minlength=part[0]))
            size, place, count = _found_terms(part)
            found = np.empty(place.size, TERM)
            found["place"], found["count"] = place, count
            ends = np.cumsum(size).tolist()
            terms += [found[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)]
        return pd.DataFrame({"n_tokens": np.concatenate(counts).astype(np.int64),
                             "terms": pd.Series(terms, dtype=object)})

    return column(F.col(text))


def _blocks(terms: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """Texts in blocks of about BLOCK_TERMS terms: their rows, how many terms each has, and the terms."""
    size = terms.str.len().to_numpy(np.int64) // TERM.itemsize
    cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // BLOCK_TERMS, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], size.size]):
        yield np.arange(a, b), size[a:b], b"".join(terms.iloc[a:b])


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents (draw, terms) in blocks: draws, first term of each, terms."""
    for pdf in batches:
        draws = pdf["draw"].to_numpy(np.int64)
        for rows, size, terms in _blocks(pdf["terms"]):
            yield pd.DataFrame({"draws": [draws[rows].tobytes()], "first": [(np.cumsum(size) - size).tobytes()],
                                "terms": [terms]})


def _units(row, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's documents as sparse unit rows: first entry of each, places, values, and which are not zero."""
    first, terms = np.frombuffer(row.first, np.int64), np.frombuffer(row.terms, TERM)
    place = terms["place"].astype(np.int64)
    x = _damped(terms["count"]) * weights[place]
    norm = np.sqrt(np.add.reduceat(x * x, first))
    size = np.diff(np.append(first, x.size))
    return first, place, x / np.repeat(np.where(norm > 0, norm, 1.0), size), norm > 0


def _nearness(first: np.ndarray, place: np.ndarray, x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Cosine of each document of a block with each centre; the last digits depend on the block."""
    ends = np.append(first, x.size)
    out = np.empty((first.size, len(centres)))
    for a in range(0, first.size, FULL_ROWS):
        b = min(first.size, a + FULL_ROWS)
        own = slice(ends[a], ends[b])
        full = np.zeros((b - a) * TOPIC_PLACES)
        full[np.repeat(np.arange(b - a) * TOPIC_PLACES, np.diff(ends[a: b + 1])) + place[own]] = x[own]
        out[a:b] = full.reshape(b - a, -1) @ centres.T
    return out


def _own_nearness(first: np.ndarray, place: np.ndarray, x: np.ndarray, centres: np.ndarray,
                  rows: np.ndarray) -> np.ndarray:
    """Cosines of some documents of a block, each summed by itself, so they are the same in any block."""
    size = np.diff(np.append(first, x.size))[rows]
    begins = np.cumsum(size) - size
    at = np.repeat(first[rows] - begins, size) + np.arange(size.sum())
    return np.add.reduceat(x[at, None] * np.ascontiguousarray(centres.T)[place[at]], begins, axis=0)


def _nearest(first: np.ndarray, place: np.ndarray, x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each document of a block (of equal ones the first)."""
    near = _nearness(first, place, x, centres)
    own = near.argmax(axis=1)
    if len(centres) > 1:
        best = np.sort(near, axis=1)
        rows = np.flatnonzero(best[:, -2] >= best[:, -1] * (1 - CLOSE))
        if rows.size:
            own[rows] = _own_nearness(first, place, x, centres, rows).argmax(axis=1)
    return own


def _summed(blocks: DataFrame, vector) -> np.ndarray:
    """Sum of ``vector(block)`` over all blocks: tasks add theirs, SUM_TASKS tasks add those, in whole numbers."""
    def added(vectors) -> Iterator[pd.DataFrame]:
        total = None
        for v in vectors:
            total = v if total is None else total + v
        if total is not None:
            yield pd.DataFrame({"total": [total.tobytes()]})

    rows = (blocks.mapInPandas(lambda it: added(vector(r) for pdf in it for r in pdf.itertuples(index=False)),
                               "total binary").repartition(SUM_TASKS)
            .mapInPandas(lambda it: added(np.frombuffer(b, np.int64) for pdf in it for b in pdf["total"]),
                         "total binary").collect())
    return sum((np.frombuffer(r["total"], np.int64) for r in rows), np.zeros(1, np.int64))


def _farthest(blocks: DataFrame, weights: np.ndarray, centres: np.ndarray) -> np.ndarray | None:
    """Unit row of the document least near to any centre (of equal ones the smallest draw); none if all lie on one."""
    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                first, place, x, fine = _units(row, weights)
                rows = np.flatnonzero(fine)
                if not rows.size:
                    continue
                near = np.zeros(rows.size, np.int64)
                if len(centres):
                    about = _nearness(first, place, x, centres).max(axis=1)[rows]
                    rows = rows[about <= about.min() + 2 / SCALE]
                    near = np.rint(_own_nearness(first, place, x, centres, rows).max(axis=1) * SCALE).astype(np.int64)
                draws = (np.frombuffer(row.draws, np.uint64)[rows] >> np.uint64(11)).astype(np.int64)
                i = np.lexsort((draws, near))[0]
                if best is None or (near[i], draws[i]) < best[:2]:
                    at = rows[i]
                    end = first[at + 1] if at + 1 < first.size else x.size
                    unit = np.zeros(TOPIC_PLACES)
                    unit[place[first[at]: end]] = x[first[at]: end]
                    best = near[i], draws[i], unit.tobytes()
        if best is not None:
            yield pd.DataFrame([best], columns=["near", "draw", "unit"])

    found = blocks.mapInPandas(least, "near long, draw long, unit binary").orderBy("near", "draw").limit(1).collect()
    return np.frombuffer(found[0]["unit"]) if found and found[0]["near"] < SCALE * (1 - 1e-9) else None


def learn_topics(docs: DataFrame, topics: int = TOPICS, rounds: int = TOPIC_ROUNDS) -> Topics:
    """Topics of all texts, equal ones counted once: spherical k-means, each round one pass over their term counts.

    Centres begin far apart: the text of least hash, then each time the text
    least near to those before. Term counts are stored once; passes return sums
    in whole numbers (unit rows times SCALE), so the result does not depend on
    how the texts are dealt.
    """
    return _fitted_topics(docs.select(_draw(F.col("text")), _counted("text").alias("p")).select("draw", "p.terms"),
                          topics, rounds)


def _draw(text: Column) -> Column:
    return F.xxhash64(F.lit(5), text).alias("draw")


def _fitted_topics(texts: DataFrame, topics: int = TOPICS, rounds: int = TOPIC_ROUNDS) -> Topics:
    """As ``learn_topics``, of the texts' draws and terms."""
    blocks = written(texts.where(F.octet_length("terms") > 0).dropDuplicates(["draw"])
                     .mapInPandas(_packed, "draws binary, first binary, terms binary"), "terms")

    def seen(row) -> np.ndarray:
        found = np.bincount(np.frombuffer(row.terms, TERM)["place"], minlength=TOPIC_PLACES + 1)
        found[-1] = len(row.first) // 8
        return found.astype(np.int64)

    found = _summed(blocks, seen)
    if not found.any():
        return Topics(np.ones(TOPIC_PLACES), np.empty((0, TOPIC_PLACES)))
    weights = np.log((1 + found[-1]) / (1 + found[:-1]))
    centres = np.empty((0, TOPIC_PLACES))
    while len(centres) < topics and (unit := _farthest(blocks, weights, centres)) is not None:
        centres = np.vstack((centres, unit))

    def moves(row, centres: np.ndarray) -> np.ndarray:
        first, place, x, fine = _units(row, weights)
        own = np.repeat(_nearest(first, place, x, centres), np.diff(np.append(first, x.size)))
        # Sums of a block stay below 2 to the power 53, so they are exact.
        return np.bincount(own * TOPIC_PLACES + place, weights=np.rint(x * SCALE),
                           minlength=centres.size).astype(np.int64)

    for _ in range(rounds if len(centres) else 0):
        sums = _summed(blocks, lambda row, now=centres: moves(row, now)).reshape(centres.shape)
        sums = np.where(sums.any(axis=1)[:, None], sums / SCALE, centres)
        moved = sums / np.linalg.norm(sums, axis=1, keepdims=True)
        if np.allclose(moved, centres):
            break
        centres = moved
    return Topics(weights, centres)


def profile(topics: Topics, text: str = "text") -> Column:
    """struct(topic, n_tokens) of a text column: the nearest centre and the number of words."""
    @F.pandas_udf(T.StructType([T.StructField("topic", T.IntegerType()), T.StructField("n_tokens", T.LongType())]))
    def column(texts: pd.Series) -> pd.DataFrame:
        found, counts = [np.empty(0)], [np.empty(0)]
        for part in _parts(texts.tolist()):
            counts.append(np.bincount(part[3], minlength=part[0]))
            found.append(topics.of(*_found_terms(part)))
        return pd.DataFrame({"topic": np.concatenate(found).astype(np.int32),
                             "n_tokens": np.concatenate(counts).astype(np.int64)})

    return column(F.col(text))


def _topic(topics: Topics, terms: str) -> Column:
    """The nearest centre of a column of terms, as ``profile`` tells it of their text."""
    @F.pandas_udf(T.IntegerType())
    def column(values: pd.Series) -> pd.Series:
        found = [np.empty(0, np.int32)]
        for _, size, block in _blocks(values):
            own = np.frombuffer(block, TERM)
            found.append(topics.of(size, own["place"].astype(np.int64), own["count"]))
        return pd.Series(np.concatenate(found))

    return column(F.col(terms))


def _profiles(docs: DataFrame, *columns: Column) -> tuple[Topics, DataFrame]:
    """The topics of the texts; and per document ``columns``, source, lang, n_tokens and topic, written.

    Each text is taken to words once, and its term counts are stored.
    """
    counted = written(docs.select(
        *columns, F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"),
        _draw(F.col("text")), _counted("text").alias("p")).select("*", "p.*").drop("p"), "counts")
    topics = _fitted_topics(counted.select("draw", "terms"))
    return topics, written(counted.withColumn("topic", _topic(topics, "terms")).drop("draw", "terms"), "profiles")


def _by_source(cells: DataFrame) -> tuple[list[tuple[str, int]], DataFrame | None]:
    """The (language, topic) pairs, and one row per source: its tokens in all and in each pair."""
    pairs = sorted((r["lang"], r["topic"]) for r in cells.select("lang", "topic").distinct().collect())
    if not pairs:
        return pairs, None
    slot = {p: i for i, p in enumerate(pairs)}
    index = F.create_map(*[x for (lang, topic), i in slot.items()
                           for x in (F.struct(F.lit(lang).alias("lang"), F.lit(topic).alias("topic")), F.lit(i))])
    at = F.element_at(index, F.struct("lang", "topic"))
    return pairs, written(cells.withColumn("at", at).groupBy("source").agg(
        F.sum("tokens").cast("double").alias("total"),
        *[F.sum(F.when(F.col("at") == i, F.col("tokens")).otherwise(0)).cast("double").alias(f"w{i}")
          for i in range(len(pairs))])
        .select("source", "total", F.array(*[f"w{i}" for i in range(len(pairs))]).alias("w")), "cells")


def rake(cells: DataFrame, temper: dict[str, float] = TEMPER) -> tuple[DataFrame, float]:
    """(source, lang, topic, ratio): the calibrated weight of one token of each cell; and the fit's largest error.

    The error is that of the language and topic shares, relative to their
    targets (sources meet theirs exactly).

    ``cells`` has source, lang, topic and tokens. Sources may be many: they
    stay distributed, one row each with its tokens by (language, topic), and a
    sweep over them returns one sum per (language, topic). Languages and topics
    are few; their factors are fitted on the driver between sweeps. The ratios
    of all tokens sum to 1.
    """
    cells = cells.where("tokens > 0")
    pairs, wide = _by_source(cells)
    if not pairs:
        return cells.select("source", "lang", "topic", F.lit(0.0).alias("ratio")), 0.0
    norm = wide.agg(F.sum(F.pow("total", F.lit(temper["source"])))).first()[0]
    goal = F.pow("total", F.lit(temper["source"])) / norm

    def factor(g: np.ndarray) -> Column:
        """What a source's tokens must be multiplied with under pair factors ``g``."""
        weighted = F.zip_with("w", F.array(*[F.lit(float(x)) for x in g]), lambda a, b: a * b)
        return goal / F.aggregate(weighted, F.lit(0.0), lambda a, b: a + b)

    mass = np.array(wide.agg(*[F.sum(F.col("w")[i]) for i in range(len(pairs))]).first(), dtype=float)
    langs, lang_of = np.unique([p[0] for p in pairs], return_inverse=True)
    topics, topic_of = np.unique([p[1] for p in pairs], return_inverse=True)

    def target(of: np.ndarray, power: float) -> np.ndarray:
        t = np.bincount(of, weights=mass) ** power
        return t / t.sum()

    want = [(lang_of, target(lang_of, temper["lang"])), (topic_of, target(topic_of, temper["topic"]))]
    g, error = np.ones(len(pairs)), np.inf
    for _ in range(MAX_SWEEPS):
        fitted = wide.select(factor(g).alias("a"), "w")
        m = np.array(fitted.agg(*[F.sum(F.col("a") * F.col("w")[i]) for i in range(len(pairs))]).first()) * g
        error = max(np.abs(np.bincount(of, weights=m) / t - 1).max() for of, t in want)
        if error < TOLERANCE:
            break
        for _ in range(50):
            for of, t in want:
                step = (t / np.bincount(of, weights=m))[of]
                g, m = g * step, m * step
    ratios = (wide.select("source", factor(g).alias("a"), F.posexplode("w").alias("i", "tokens")).where("tokens > 0")
            .select("source", F.element_at(F.array(*[F.lit(str(p[0])) for p in pairs]), F.col("i") + 1).alias("lang"),
                    F.element_at(F.array(*[F.lit(int(p[1])) for p in pairs]), F.col("i") + 1).alias("topic"),
                    (F.col("a") * F.element_at(F.array(*[F.lit(float(x)) for x in g]), F.col("i") + 1)).alias("ratio")))
    return ratios, float(error)


def filled(size: np.ndarray, power: float, goal: float) -> np.ndarray:
    """Targets that sum to ``goal``: in proportion to size to ``power``, none above its size."""
    ask, c = size ** power, 0.0
    while True:
        whole = c * ask >= size
        if whole.all():
            return size.copy()
        more = (goal - size[whole].sum()) / ask[~whole].sum()
        if more <= c * (1 + 1e-12):
            return np.where(whole, size, c * ask)
        c = more


def capped_factors(w: np.ndarray, g: np.ndarray, aim: np.ndarray) -> np.ndarray:
    """Per row of ``w`` the probabilities min(1, a * g), with a such that the row keeps ``aim`` tokens."""
    a = aim / (w * g).sum(axis=1)
    for _ in range(g.size):
        whole = a[:, None] * g >= 1
        rest = np.where(whole, 0.0, w * g).sum(axis=1)
        more = np.divide(aim - np.where(whole, w, 0.0).sum(axis=1), rest, out=a.copy(), where=rest > 0)
        if (more <= a * (1 + 1e-12)).all():
            break
        a = np.maximum(a, more)
    return np.minimum(1.0, a[:, None] * g)


def capped_probabilities(cells: DataFrame, temper: dict[str, float], share: float) -> tuple[DataFrame, float]:
    """(source, lang, topic, probability) of a sample that keeps ``share`` (below 1) of the tokens, and its error.

    The error is the largest of the languages' and topics' kept tokens, relative to their targets.

    Targets are those of ``rake`` times the sample's size; a value whose target
    exceeds its tokens is kept whole and the others of its level share the
    difference. Probabilities are min(1, source factor * pair factor). Sources
    meet their targets exactly, so the sample has its size; languages and
    topics meet theirs as nearly as cells kept whole allow.
    """
    pairs, wide = _by_source(cells.where("tokens > 0"))
    n = len(pairs)
    mass = np.array(wide.agg(*[F.sum(F.col("w")[i]) for i in range(n)]).first(), dtype=float)
    goal = share * mass.sum()
    # As in ``filled``, over the distributed sources.
    ask, c = F.pow("total", F.lit(temper["source"])), 0.0
    while True:
        whole = F.lit(c) * ask >= F.col("total")
        kept, rest = wide.agg(F.sum(F.when(whole, F.col("total"))), F.sum(F.when(~whole, ask))).first()
        if not rest or (goal - (kept or 0.0)) / rest <= c * (1 + 1e-12):
            break
        c = (goal - (kept or 0.0)) / rest
    wide = wide.select("source", "w", F.least(F.col("total"), F.lit(c) * ask).alias("aim"))
    want = []
    for level, values in (("lang", [p[0] for p in pairs]), ("topic", [p[1] for p in pairs])):
        of = np.unique(values, return_inverse=True)[1]
        want.append((of, filled(np.bincount(of, weights=mass), temper[level], goal)))

    def chances(pdf: pd.DataFrame, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = np.stack(pdf["w"].to_numpy())
        return w, capped_factors(w, g, pdf["aim"].to_numpy())

    def sums(batches: Iterator[pd.DataFrame], g: np.ndarray) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                w, p = chances(pdf, g)
                yield pd.DataFrame({"part": [np.where(p < 1, w * p, 0.0).sum(axis=0).tolist()],
                                    "whole": [np.where(p < 1, 0.0, w).sum(axis=0).tolist()]})

    g, best, least, idle = np.ones(n), np.ones(n), np.inf, 0
    for _ in range(CAPPED_SWEEPS):
        found = wide.mapInPandas(lambda it, g=g: sums(it, g), "part array<double>, whole array<double>").agg(
            *[F.sum(F.col(x)[i]) for x in ("part", "whole") for i in range(n)]).first()
        m, k = np.array(found[:n], dtype=float), np.array(found[n:], dtype=float)
        error = max(np.abs(np.bincount(of, weights=m + k) / t - 1).max() for of, t in want)
        idle = 0 if error < 0.9 * least else idle + 1
        if error < least:
            best, least = g, error
        if error < CAPPED_TOLERANCE or idle > 4:
            break
        for _ in range(50):
            for of, t in want:
                some, whole = np.bincount(of, weights=m), np.bincount(of, weights=k)
                step = np.divide(t - whole, some, out=np.where(whole > t, 0.5, 1.0), where=some > 0)
                step = np.clip(step, 0.5, 2.0)[of]
                g, m = g * step, m * step

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                w, p = chances(pdf, best)
                row, pair = np.nonzero(w)
                yield pd.DataFrame({"source": pdf["source"].to_numpy()[row], "lang": [pairs[i][0] for i in pair],
                                    "topic": [pairs[i][1] for i in pair], "probability": p[row, pair]})

    return wide.mapInPandas(named, "source string, lang string, topic int, probability double"), float(least)


def _fit_languages(rows: DataFrame) -> list[str]:
    """The languages of most tokens, which have a target of their own."""
    sizes = rows.groupBy("lang").agg(F.sum("n_tokens").alias("n")).where("n > 0")
    return [r["lang"] for r in sizes.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()]


def _cell_language(known: list[str], lang: str = "lang") -> Column:
    return F.when(F.col(lang).isin(known), F.col(lang)).otherwise(F.lit(OTHER)) if known else F.lit(OTHER)


def _cells(df: DataFrame, temper: dict[str, float], share: float | None) -> DataFrame:
    """Per cell of (source, lang, topic, n_tokens): probability, relative weight, and which fit gave them how well."""
    cells = written(df.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens")), "cells")
    ratios, error = rake(cells, temper)
    ratios, fit = written(ratios, "ratios"), "raked"
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    top = ratios.agg(F.max("ratio")).first()[0] or 1.0
    chances = ratios.select("source", "lang", "topic", (F.col("ratio") / top).alias("probability"))
    if share is not None and total and top * total * share > 1:  # the ratios of all tokens sum to 1
        chances, error = capped_probabilities(cells, temper, share)
        chances, fit = written(chances, "capped"), "capped"
    return (cells.join(ratios, ["source", "lang", "topic"], "left").join(chances, ["source", "lang", "topic"], "left")
            .select("source", "lang", "topic", (F.coalesce("ratio", F.lit(0.0)) * total).alias("weight"),
                    F.coalesce("probability", F.lit(1.0)).alias("probability"), F.lit(fit).alias("fit"),
                    F.lit(error).alias("fit_error")))


def _place(seed: int, doc_id: str, text: Column) -> Column:
    return ((F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 11).cast("double") + 0.5)
            * F.lit(2.0 ** -53))


def mix_sources(docs: DataFrame, temper: dict[str, float] = TEMPER, seed: int = SEED,
                share: float | None = None) -> DataFrame:
    """Per document its cell, the cell's calibrated weight, its probability and whether the sample keeps it.

    Columns: doc_id, source, lang, topic, n_tokens (words), weight (target over
    actual token share of the cell), probability, kept, fit (``raked``: the
    probabilities are the weights over the largest one; ``capped``: the fit
    with cells kept whole) and fit_error (largest relative error of a language
    or topic against its target in that fit). Null sources and languages are
    the value ''; languages beyond the LANGUAGES of most tokens share one cell
    value in the fit. Topics are learned from all texts, see
    ``learn_topics``; a text without long words has topic 0. Empty and null
    texts have no tokens: they weigh nothing in the fit and share their cell's
    probability; in a cell without tokens it is 1. A draw is a hash of doc_id
    and text, so equal rows share one draw. An empty table gives no rows. Other
    columns are not read. With a ``share`` (below 1) the sample keeps at least
    that share of the tokens in expectation, and some cells whole where the
    targets alone would keep less.
    """
    small_batches(docs.sparkSession)
    _, rows = _profiles(docs, F.col("doc_id").cast("long").alias("doc_id"),
                        _place(seed, "doc_id", F.col("text")).alias("u"))
    known = _fit_languages(rows)
    rows = rows.withColumnRenamed("lang", "own").withColumn("lang", _cell_language(known, "own"))
    return (rows.join(_cells(rows, temper, share), ["source", "lang", "topic"])
            .select("doc_id", "source", F.col("own").alias("lang"), "topic", "n_tokens", "weight", "probability",
                    (F.col("u") < F.col("probability")).alias("kept"), "fit", "fit_error"))


def mixed_documents(docs: DataFrame, temper: dict[str, float] = TEMPER, seed: int = SEED,
                    share: float | None = None) -> DataFrame:
    """The sampled rows of ``docs`` with its own columns, decided as in ``mix_sources``."""
    small_batches(docs.sparkSession)
    name = "cell"
    while name in docs.columns:
        name += "_"
    topics, flat = _profiles(docs)
    rows = docs.withColumn(name, F.struct(F.coalesce("source", F.lit("")).alias("source"),
                                          F.coalesce("lang", F.lit("")).alias("lang"), profile(topics).alias("p")))
    known = _fit_languages(flat)
    cells = written(_cells(flat.withColumn("lang", _cell_language(known)), temper, share).select(
        F.struct("source", "lang", "topic").alias(f"{name}k"), F.col("probability").alias(f"{name}p")), "chances")
    return (rows.withColumn(f"{name}k", F.struct(f"{name}.source", _cell_language(known, f"{name}.lang").alias("lang"),
                                                 f"{name}.p.topic"))
            .join(cells, f"{name}k").where(_place(seed, "doc_id", F.col("text")) < F.col(f"{name}p"))
            .select(*docs.columns))

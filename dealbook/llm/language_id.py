"""Language of a text by a byte convolutional network.

Filters of several widths run over the bytes of fixed-length windows; each
filter keeps its maximum over the window, and a softmax over these maxima gives
the window's language probabilities. A text's probabilities are the mean of
its windows' log probabilities, weighted by their bytes. The network is trained in numpy.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealbook.llm.common import small_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 24
#: Bound of the training sample: at most about this many documents of each language, picked by a hash of doc_id.
TRAIN_PER_LANGUAGE = 600
#: Languages that are learned: the ones of most labelled documents (a dirty label column has any number of values).
MAX_LANGUAGES = 200
#: Pieces of each training document, and their largest length in characters.
PIECES, PIECE_CHARS = 4, 256
BATCH, STEPS = 128, 480
RATE = 0.004
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
#: A document with a score below this is rejected by the pipeline.
MIN_SCORE = 0.3
#: Windows that run through the network together.
ROWS = 64
_PAD = 0x20


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter (signs that only stand for numbers are none)."""
    return text is not None and any(map(str.isalpha, text))


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts' lower-case bytes: (rows of WINDOW bytes, text of each, bytes in each)."""
    raw = [t.lower().encode("utf-8", "replace") or b" " for t in texts]
    n = np.array([-(-len(r) // WINDOW) for r in raw])
    flat = np.frombuffer(b"".join([r.ljust(k * WINDOW, b" ") for r, k in zip(raw, n.tolist())]), np.uint8)
    owner = np.repeat(np.arange(len(raw)), n)
    held = np.full(owner.size, WINDOW)
    last = np.cumsum(n) - 1
    held[last] = np.array([len(r) for r in raw]) - (n - 1) * WINDOW
    return flat.reshape(-1, WINDOW), owner, held


class Network:
    """Filters as tables: ``filters[w][k, byte]`` is what byte ``byte`` at offset k adds to each filter of width w."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.filters = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.dense = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.out = np.zeros(len(languages), dtype=np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.filters.values(), self.bias, self.dense, self.out]

    def _forward(self, x: np.ndarray):
        peak, at = [], []
        for w, table in self.filters.items():
            n = x.shape[1] - w + 1
            z = table[0][x[:, :n]]
            for k in range(1, w):
                z += table[k][x[:, k: k + n]]
            best = z.argmax(axis=1)
            at.append(best)
            peak.append(np.take_along_axis(z, best[:, None, :], axis=1)[:, 0])
        h = np.concatenate(peak, axis=1) + self.bias
        relu = np.maximum(h, 0)
        logits = relu @ self.dense + self.out
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return at, relu, p / p.sum(axis=1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        at, relu, p = self._forward(x)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        dh = (p @ self.dense.T) * (relu > 0)
        grads = []
        f = np.arange(FILTERS)
        for i, (w, table) in enumerate(self.filters.items()):
            g = np.zeros_like(table)
            part = dh[:, i * FILTERS: (i + 1) * FILTERS]
            for k in range(w):
                np.add.at(g[k], (np.take_along_axis(x, at[i] + k, axis=1), f[None, :]), part)
            grads.append(g)
        return [*grads, dh.sum(axis=0), relu.T @ p, p.sum(axis=0)]

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 9) -> None:
        rng = np.random.default_rng(seed)
        params = self.parameters()
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        order = np.concatenate([rng.permutation(len(y)) for _ in range(-(-STEPS * BATCH // len(y)))])
        for step in range(1, STEPS + 1):
            some = order[(step - 1) * BATCH: step * BATCH]
            for p, g, a, b in zip(params, self.gradients(x[some], y[some]), m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= RATE * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Log softmax of many windows; byte pairs share one table look-up."""
        pair = {}
        for w, table in self.filters.items():
            for k in range(0, w - 1, 2):
                pair[w, k] = (table[k][:, None, :] + table[k + 1][None, :, :]).reshape(65536, FILTERS)
        out = np.empty((len(x), len(self.languages)))
        for first in range(0, len(x), ROWS):
            rows = x[first: first + ROWS]
            both = rows[:, :-1].astype(np.int32) << 8 | rows[:, 1:]
            peaks = []
            for w, table in self.filters.items():
                n = WINDOW - w + 1
                z = pair[w, 0].take(both[:, :n], axis=0)
                for k in range(2, w - 1, 2):
                    z += pair[w, k].take(both[:, k: k + n], axis=0)
                if w % 2:
                    z += table[w - 1].take(rows[:, w - 1: w - 1 + n], axis=0)
                peaks.append(z.max(axis=1))
            logits = np.maximum(np.concatenate(peaks, axis=1) + self.bias, 0) @ self.dense + self.out
            logits = logits.astype(np.float64) - logits.max(axis=1, keepdims=True)
            out[first: first + ROWS] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of whole texts; UNKNOWN with score 0 for those without a letter."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        some = [i for i, t in enumerate(texts) if has_letter(t)]
        for a in range(0, len(some), 512):
            part = some[a: a + 512]
            x, owner, held = windows([texts[i] for i in part])
            logp = self.log_probabilities(x) * held[:, None]
            total = np.zeros((len(part), len(self.languages)))
            np.add.at(total, owner, logp)
            mean = total / np.bincount(owner, weights=held, minlength=len(part))[:, None]
            p = np.exp(mean - mean.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for i, best, score in zip(part, p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
                names[i], scores[i] = self.languages[best], score
        return names, scores


def train(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> Network | None:
    """A network fitted on pieces of a bounded sample of the labelled texts outside the held-out fold."""
    small_batches(docs.sparkSession)
    known = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
             .where("doc_id is not null and lang is not null and text is not null")
             .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    if not sizes:
        return None
    share = F.coalesce(F.element_at(F.create_map(*[x for lang, n in sizes.items() for x in (
        F.lit(lang), F.lit(min(1.0, per_language / n)))]), F.col("lang")), F.lit(0.0))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(2), "doc_id"), 11).cast("double") * F.lit(2.0 ** -53)
    # Pieces start all over the text and have all lengths, so short texts are learned too.
    spot = [F.pmod(F.xxhash64(F.lit(10 + k), "doc_id"), F.greatest(F.length("text") - 40, F.lit(1))) for k in range(PIECES)]
    long = [F.pmod(F.xxhash64(F.lit(20 + k), "doc_id"), F.lit(PIECE_CHARS)) + 12 for k in range(PIECES)]
    piece = F.array(*[F.substring("text", (a + 1).cast("int"), b.cast("int")) for a, b in zip(spot, long)])
    sample = (known.where(draw < share).select("doc_id", "lang", F.explode(piece).alias("piece"))
              .toPandas().sort_values(["doc_id", "lang", "piece"]))
    sample = sample[[has_letter(t) for t in sample["piece"]]]
    languages = sorted(sample["lang"].unique().tolist())
    if not languages:
        return None
    net = Network(languages)
    x, owner, _ = windows(sample["piece"].tolist())
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    net.fit(x[first], np.searchsorted(languages, sample["lang"].to_numpy()))
    return net


def language_column(net: Network | None, text: str = "text"):
    """struct(lang_pred, score) of a text column."""
    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        if net is None:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0})
        names, scores = net.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return predict(F.col(text))


def identify_language(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred and score (0 to 1).

    Learned from documents with a lang whose crc32(doc_id as text) mod 3 is not
    1; held_out marks the others. A prediction reads the whole text and
    nothing else. Null texts and texts without a letter are ``und`` with score
    0, as is every text if nothing can be learned. A null doc_id is not held
    out; repeated rows get the same answer. Other columns are not read.
    """
    net = train(docs)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), language_column(net).alias("p"))
    return rows.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "p.lang_pred", "p.score")


def known_language_documents(docs: DataFrame, all_docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in a language that was learned, by a score of MIN_SCORE or more.

    Learned from ``all_docs``, as in ``identify_language``. Null, empty and
    letterless texts go; equal rows stay or go together; columns stay as they
    are. Where no language can be learned nothing is told apart, and all rows
    with a letter stay. An empty table gives an empty one.
    """
    net = train(all_docs)
    if net is None:
        lettered = F.pandas_udf(lambda texts: texts.map(has_letter).astype(bool), "boolean")
        return docs.where(lettered("text"))
    return docs.where(language_column(net)["score"] >= MIN_SCORE)

"""Toxicity score: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Each n-gram (3 to 5 characters of the text in lower case, by a hash bucket) is
present or not. Its feature value is the log ratio of its smoothed document
frequencies among toxic and other documents; a logistic regression on these
values is the classifier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealbook.llm.common import small_batches, written

ORDERS = (3, 4, 5)
BUCKET_BITS = 22
#: Bound of the training sample: at most about this many documents of each label, picked by a hash of doc_id.
TRAIN_PER_LABEL = 6000
FOLDS = 5
#: An n-gram needs this many training documents, and this much strength; all such n-grams are features.
MIN_DOCUMENTS = 3
MIN_STRENGTH = 6.0
SMOOTHING = 0.5
PENALTY = 1e-3
STEPS = 300
#: Characters handled together, and texts whose n-grams are held together.
CHUNK, GROUP = 1 << 18, 64
_MULT = np.uint32(0x9E3779B1)


def buckets(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For groups of texts: the n-gram buckets at every place, by order, with the text each lies in.

    Yields (document, bucket) arrays, one pair per order; n-grams do not cross texts.
    """
    i = 0
    while i < len(texts):
        part, size = [], 0
        while i + len(part) < len(texts) and size < CHUNK:
            part.append((texts[i + len(part)] or "").lower())
            size += len(part[-1]) + 1
        code = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum([len(p) for p in part])
        doc = np.repeat(np.arange(i, i + len(part), dtype=np.int32), [len(p) for p in part])
        h = np.zeros(code.size, dtype=np.uint32)
        for k in range(max(ORDERS)):
            # h[j] covers the k + 1 characters from j on.
            n = code.size - k
            if n <= 0:
                break
            h = (h[:n] ^ (code[k:] + np.uint32(k + 1))) * _MULT
            h ^= h >> np.uint32(15)
            if k + 1 in ORDERS:
                inside = doc[:n] == doc[k:]
                yield doc[:n][inside], (h[inside] * _MULT) >> np.uint32(32 - BUCKET_BITS)
        i += len(part)


def label_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Document frequencies of a partition's n-grams among toxic and other documents."""
    size = 1 << BUCKET_BITS
    counts = np.zeros((2, size), dtype=np.int32)
    for pdf in batches:
        label = pdf["label"].to_numpy()
        for text, y in zip(pdf["text"].tolist(), label.tolist()):
            found = [b for _, b in buckets([text])]
            if found:
                counts[y, np.unique(np.concatenate(found))] += 1
    for first in range(0, size, size // 32):
        part = counts[:, first: first + size // 32]
        some = np.flatnonzero(part.any(axis=0))
        yield pd.DataFrame({"bucket": some + first, "other": part[0, some].astype(np.int64),
                            "toxic": part[1, some].astype(np.int64)})


class Model:
    """Kept buckets (sorted), the weight of each and the intercept."""

    def __init__(self, kept: np.ndarray, weights: np.ndarray, intercept: float):
        self.kept, self.weights, self.intercept = kept, weights, intercept
        self._place: np.ndarray | None = None  # feature of each bucket, built where it is used

    def hits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(document, feature) pairs of the kept n-grams that are present, each once."""
        if self._place is None:
            self._place = np.full(1 << BUCKET_BITS, -1, dtype=np.int32)
            self._place[self.kept] = np.arange(self.kept.size)
        place = self._place
        docs, feats = [], []
        for doc, bucket in buckets(texts):
            f = place[bucket]
            some = np.flatnonzero(f >= 0)
            docs.append(doc[some])
            feats.append(f[some])
        if not docs:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = np.unique(np.concatenate(docs).astype(np.int64) * max(1, self.kept.size) + np.concatenate(feats))
        return np.divmod(both, max(1, self.kept.size))

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = np.zeros(len(texts))
        for first in range(0, len(texts), GROUP):
            doc, feature = self.hits(texts[first: first + GROUP])
            part = z[first: first + GROUP]
            part += np.bincount(doc, weights=self.weights[feature], minlength=part.size)
        return 1.0 / (1.0 + np.exp(-np.clip(z + self.intercept, -30, 30)))


#: (document, feature) pairs of one step of the fit: bounds its memory.
PAIRS = 1 << 20


def fit_logistic(lens: np.ndarray, feature: np.ndarray, ratio: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam on the mean log loss, both labels of equal total weight.

    ``feature`` lists the features of all documents, ``lens`` how many each
    has, ``ratio`` is the value of a feature where it is present. Documents go
    through a step in slices of about PAIRS pairs.
    """
    n = ratio.size
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    ends = np.cumsum(lens)
    cuts = [0]
    while cuts[-1] < y.size:
        done = ends[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, done + PAIRS, "right"))))
    slices = [(a, min(b, y.size)) for a, b in zip(cuts[:-1], cuts[1:])]
    w, b = np.zeros(n), 0.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        grad = np.append(PENALTY * w, 0.0)
        scaled = w * ratio
        for first, last in slices:
            start = ends[first] - lens[first]
            f = feature[start: ends[last - 1]]
            doc = np.repeat(np.arange(last - first), lens[first:last])
            z = np.bincount(doc, weights=scaled[f], minlength=last - first) + b
            error = weight[first:last] * (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y[first:last])
            grad[:n] += ratio * np.bincount(f, weights=error[doc], minlength=n)
            grad[n] += error.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = 0.02 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-12)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL, folds: int = FOLDS) -> Model:
    """Fits the classifier on a bounded sample of the labelled documents outside the held-out fold."""
    small_batches(docs.sparkSession)
    labels = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
              .where("doc_id is not null and label in (0, 1)")
              .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0)
              .groupBy("doc_id").agg(F.max("label").alias("label")))
    known = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(known) < 2:
        return Model(np.empty(0, np.int64), np.empty(0), -30.0 if 1 not in known else 0.0)
    share = F.lit(1.0)
    for label, n in known.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, per_label / n))).otherwise(share)
    picked = labels.where((F.shiftrightunsigned(F.xxhash64(F.lit(3), "doc_id"), 11).cast("double") * F.lit(2.0 ** -53))
                          < share)
    # The sample is bounded, so its ids may be broadcast; its texts then lie in few partitions.
    sample = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                     .join(F.broadcast(picked), "doc_id").repartition(6, "doc_id"), "labelled")
    y_counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = y_counts.get(0, 0), y_counts.get(1, 0)
    if not n0 or not n1:
        return Model(np.empty(0, np.int64), np.empty(0), -30.0 if not n1 else 0.0)
    p = (F.col("toxic") + SMOOTHING) / (n1 + 2 * SMOOTHING)
    q = (F.col("other") + SMOOTHING) / (n0 + 2 * SMOOTHING)
    # Strength: the G statistic of independence, so that chance n-grams of few documents stay out.
    total, seen = float(n0 + n1), F.col("toxic") + F.col("other")

    def part(found, expected):
        return F.when(found > 0, found * F.log(found / expected)).otherwise(0.0)

    strength = (part(F.col("toxic"), seen * (n1 / total)) + part(F.col("other"), seen * (n0 / total))
                + part(n1 - F.col("toxic"), (total - seen) * (n1 / total))
                + part(n0 - F.col("other"), (total - seen) * (n0 / total)))
    top = (sample.select("label", "text").mapInPandas(label_counts, "bucket long, other long, toxic long")
           .groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
           .where(F.col("other") + F.col("toxic") >= MIN_DOCUMENTS)
           .select("bucket", F.log(p / q).alias("ratio"), strength.alias("strength"))
           .where(F.col("strength") >= MIN_STRENGTH).select("bucket", "ratio").toPandas().sort_values("bucket"))
    kept, r = top["bucket"].to_numpy(dtype=np.int64), top["ratio"].to_numpy(dtype=float)
    bare = Model(kept, r, 0.0)

    kind = np.uint16 if kept.size < 1 << 16 else np.int32

    def features(batches):
        for pdf in batches:
            texts, found = pdf["text"].tolist(), []
            for first in range(0, len(texts), GROUP):
                doc, feature = bare.hits(texts[first: first + GROUP])
                cuts = np.searchsorted(doc, np.arange(min(GROUP, len(texts) - first) + 1))
                found += [feature[a:b].astype(kind).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "features": found})

    rows = (sample.mapInPandas(features, "doc_id long, label int, features binary").toPandas()
            .sort_values("doc_id", kind="stable"))
    lens = (rows["features"].str.len() // kind().itemsize).to_numpy()
    w, b = fit_logistic(lens, np.frombuffer(b"".join(rows["features"]), kind), r, rows["label"].to_numpy())
    return Model(kept, w * r, b)


def score_column(model: Model, text: str = "text"):
    """The toxicity score of a text column."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.tolist()))

    return score(F.col(text))


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1) and predicted (1 if score >= 0.5).

    Labels are learned only from documents whose crc32(doc_id as text) mod
    ``folds`` is not 0; held_out marks the others. A score depends on the whole
    text alone; a null or empty text gets the score of no n-grams. Documents
    with a null doc_id are scored and not held out. Repeated rows score alike;
    a doc_id with several labels counts as toxic if one says so; null labels
    are left out. With only one label known, the score is a constant. Other
    columns are not read.
    """
    model = train(docs, labels, folds=folds)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(model).alias("score"))
    return rows.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, all_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with its own columns; trained on ``all_docs``.

    Null and empty texts score as texts without n-grams, equal rows score
    alike. Where the labels known are not of both kinds nothing is told apart,
    and all rows stay. An empty table gives an empty one.
    """
    model = train(all_docs, labels)
    return docs.where(score_column(model) < 0.5) if model.kept.size else docs

"""Ranked lexical search of items in whole documents by scanning, without an index of the documents.

All terms of the items go into one Aho-Corasick automaton as " term ": texts
are folded (A-Z lower-cased, every other ASCII character that is no letter or
digit made a space), so the spaces guard both ends of a term. Two scans of the
documents follow: the first counts in how many each term occurs, the second
counts each document's term frequencies and adds the weights of every match to
the items that hold the term. Tasks keep the best documents of each item.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealbook.llm.common import small_batches
from dealbook.llm.words import slices

TOP = 20
#: Scaled BM25: weight 12 (k1 of 1.2 by 10) and length share 25 percent.
SATURATION, LENGTH_PERCENT = 12, 25
#: Item text that one automaton holds, with ROW_BYTES for each item; more items are searched in several rounds.
ITEM_BYTES, ROW_BYTES = 32_000_000, 64
#: Scores that a task holds at a time (documents x items).
CELLS = 2_000_000
#: Rows of the first scan that are no term: documents with a term, and terms of all documents.
_DOCUMENTS, _LENGTH = -1, -2

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c > 0x7F else 0x20
              for c in range(256))


def folded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass").translate(_FOLD)


class Items:
    """The terms of items and, for each term, which items hold it how often."""

    def __init__(self, texts: list[str | None]):
        number: dict[bytes, int] = {}
        held: list[tuple[int, int, int]] = []
        for i, text in enumerate(texts):
            for term, times in Counter(folded(text).split()).items():
                held.append((number.setdefault(term, len(number)), i, times))
        self.size, self.terms = len(texts), list(number)
        rows = np.array(sorted(held), dtype=np.int64).reshape(-1, 3)
        #: Items of term t are ``item[begin[t]: begin[t + 1]]``, each so many ``times``.
        self.begin = np.searchsorted(rows[:, 0], np.arange(len(number) + 1))
        self.item, self.times = rows[:, 1], rows[:, 2]

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for k, term in enumerate(self.terms):
            out.add_word(f" {term.decode('utf-8', 'surrogatepass')} ", k)
        if self.terms:
            out.make_automaton()
        return out


def counted(texts: list[str | None], automaton) -> Iterator[tuple[int, dict[int, int]]]:
    """Terms of each text with repeats, and how often each of the automaton's terms occurs in it."""
    value = itemgetter(1)
    for text in texts:
        raw = folded(text)
        n = len(raw.split())
        found = Counter(map(value, automaton.iter(f" {raw.decode('utf-8', 'surrogatepass')} "))) \
            if n and len(automaton) else {}
        yield n, found


def term_statistics(batches: Iterator[pd.DataFrame], items: Items) -> Iterator[pd.DataFrame]:
    """A task's documents of each term, documents with a term, and terms with repeats."""
    automaton = items.automaton()
    df, documents, length = np.zeros(len(items.terms), np.int64), 0, 0
    for pdf in slices(batches):
        for n, found in counted(pdf["text"].tolist(), automaton):
            documents += n > 0
            length += n
            df[list(found)] += 1
    some = np.flatnonzero(df)
    yield pd.DataFrame({"term": np.append(some, [_DOCUMENTS, _LENGTH]),
                        "n": np.append(df[some], [documents, length])})


class Best:
    """The ``top`` highest-scoring documents of each item; ties go to the smaller id, nulls last."""

    def __init__(self, size: int, top: int):
        self.top, self.least = top, np.zeros(size, np.int64)
        self.rows = np.empty((0, 4), np.int64)  # item, score, unknown id, id

    def add(self, scores: np.ndarray, unknown: np.ndarray, ids: np.ndarray) -> None:
        """Scores of documents (rows) for all items (columns)."""
        least = self.least
        if scores.shape[0] > self.top:
            at = scores.shape[0] - self.top
            least = np.maximum(least, np.partition(scores, at, axis=0)[at])
        doc, item = np.nonzero((scores >= least) & (scores > 0))
        fresh = np.column_stack((item, scores[doc, item], unknown[doc], ids[doc]))
        rows = np.concatenate((self.rows, fresh))
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        first = np.searchsorted(rows[:, 0], rows[:, 0], "left")
        place = np.arange(len(rows)) - first
        self.rows = rows[place < self.top]
        full = rows[place == self.top - 1]
        self.least[full[:, 0]] = full[:, 1]


def scores_of(found: list[dict[int, int]], norm: np.ndarray, weight: np.ndarray, items: Items) -> np.ndarray:
    """Scores of documents (rows) for all items (columns), from their term counts and length norms."""
    per_doc = np.array([len(f) for f in found], dtype=np.int64)
    doc = np.repeat(np.arange(len(found)), per_doc)
    term = np.fromiter((t for f in found for t in f), dtype=np.int64, count=doc.size)
    tf = np.fromiter((c for f in found for c in f.values()), dtype=np.int64, count=doc.size)
    value = weight[term] * (1_000_000_000 * tf // (1000 * tf + SATURATION * norm[doc]))
    # Every match spreads to the items of its term.
    spread = items.begin[term + 1] - items.begin[term]
    at = np.repeat(items.begin[term] - (np.cumsum(spread) - spread), spread) + np.arange(int(spread.sum()))
    out = np.zeros(len(found) * items.size, dtype=np.int64)
    np.add.at(out, np.repeat(doc, spread) * items.size + items.item[at], np.repeat(value, spread) * items.times[at])
    return out.reshape(len(found), items.size)


def best_documents(batches: Iterator[pd.DataFrame], items: Items, weight: np.ndarray, documents: int, length: int,
                   top: int) -> Iterator[pd.DataFrame]:
    """A task's best documents of each item."""
    automaton, best = items.automaton(), Best(items.size, top)
    block = max(1, CELLS // max(1, items.size))
    for pdf in slices(batches):
        for a in range(0, len(pdf), block):
            part = pdf.iloc[a: a + block]
            ids = part["doc_id"]
            counts = list(counted(part["text"].tolist(), automaton))
            norm = np.array([100 - LENGTH_PERCENT + LENGTH_PERCENT * n * documents // length for n, _ in counts],
                            dtype=np.int64)
            best.add(scores_of([f for _, f in counts], norm, weight, items),
                     ids.isna().to_numpy().astype(np.int64), ids.fillna(0).to_numpy().astype(np.int64))
    yield pd.DataFrame(best.rows, columns=["item", "score", "unknown", "id"]).astype({"unknown": bool})


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of each term, in doubles."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df],
                    dtype=np.int64)


def _search(docs: DataFrame, queries: list, top: int) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Items([r["text"] for r in queries]))
    stats = docs.mapInPandas(lambda b: term_statistics(b, shared.value), "term long, n long")
    # One row per term of the items at most, whose bytes are bounded.
    total = {r["term"]: r["n"] for r in stats.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    documents, length = total.get(_DOCUMENTS, 0), total.get(_LENGTH, 0)
    weight = weights(np.array([total.get(k, 0) for k in range(len(shared.value.terms))]), documents)
    found = docs.mapInPandas(lambda b: best_documents(b, shared.value, weight, documents, length or 1, top),
                             "item long, score long, unknown boolean, id long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "unknown", "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(queries)], "item long, item_id long")
    return ranked.join(F.broadcast(names), "item").select(
        "item_id", "rank", F.when(~F.col("unknown"), F.col("id")).alias("doc_id"), "score")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The ``top`` documents of each item by a scaled BM25 in integers.

    ``docs`` needs doc_id and text, ``items`` needs item_id and text; other
    columns are ignored. Terms are the longest stretches of ASCII letters,
    digits and non-ASCII characters, A-Z lower-cased. Returns item_id, rank
    (from 1), doc_id, score for scores above 0, ties by ascending doc_id with
    null ids last. Null and empty texts have no term: such a document is never
    found and counts in no statistic, such an item finds nothing. Every row of
    ``docs`` is a document of its own, so repeated rows are listed each (they
    tie); every row of ``items`` is an item of its own. Texts are whole at any
    length; empty tables give an empty one. Items beyond ``item_bytes`` of text
    are searched in several rounds, each over all documents.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    rounds = -(-size // item_bytes) or 1
    out = None
    for k in range(rounds):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == k) if rounds > 1 else items
        found = _search(docs, part.collect(), top)
        out = found if out is None else out.unionByName(found)
    return out


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
RANKED_SEARCH_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
totals AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS l FROM docs),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM docs) GROUP BY r, term),
items AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS ts FROM benchmark),
held AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(ts) AS term FROM items)
         GROUP BY q, item_id, term),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
           FROM tf, totals WHERE term IN (SELECT term FROM held) GROUP BY term, n_docs),
norm AS (SELECT r, doc_id, 75 + (25 * len(ts) * n_docs) // l AS m FROM docs, totals WHERE len(ts) > 0),
scored AS (SELECT q, item_id, tf.r, doc_id,
                  sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
           FROM held JOIN tf USING (term) JOIN weight USING (term) JOIN norm ON norm.r = tf.r
           GROUP BY q, item_id, tf.r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank
           FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from dealbook.llm import lexical_search as ls
from dealbook.llm.lexical_search import ranked_search

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=20):
    every = [terms(t) for _, t in docs]
    n_docs, length = sum(bool(e) for e in every), sum(map(len, every))
    df = Counter(t for e in every for t in set(e))
    out = []
    for item_id, text in items:
        scored = []
        for (doc_id, _), e in zip(docs, every):
            tf, score = Counter(e), 0
            for t in terms(text):
                if tf[t]:
                    m = 75 + 25 * len(e) * n_docs // length
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * tf[t] // (1000 * tf[t] + 12 * m))
            if score:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, k + 1, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def corpus(rng, n):
    words = ["the", "The", "THE", "a", "İ", "ñandú", "Ñandú", "中文", "x1", "1x", "the1", "z z"] + \
        [f"w{i}" for i in range(60)]
    seps = [" ", "-", "\n", "_", "  ", "'", "\x7f", "\x00"]
    return ["".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.choice([0, 1, 5, 30, 80])))
            for _ in range(n)]


def got(spark, docs, items, **how):
    return sorted((tuple(r) for r in ranked_search(docs, items, **how).collect()), key=str)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(4)
    texts = corpus(rng, 120)
    docs = list(enumerate(texts)) + [(500 + i, texts[7]) for i in range(30)]
    docs += [(None, texts[7]), (None, "the w1"), (900, None), (901, ""), (902, "-- !"), (3, texts[3]), (3, texts[3]),
             (903, "w5 " * 30_000)]
    items = list(enumerate(corpus(rng, 12))) + [(50, None), (51, ""), (52, "nowhere"), (3, "the the w1"),
                                                (None, "w2 ñandú"), (53, texts[7]), (53, texts[7])]
    return docs, items


@pytest.mark.parametrize("how", [{}, {"top": 3}, {"item_bytes": 1200}])
def test_equals_brute_force(spark, make_docs, clashing, case, how):
    docs, items = case
    df = clashing(make_docs([(i, t, "en", "s") for i, t in docs], parts=5))
    assert got(spark, df, clashing(spark.createDataFrame(items, ITEMS)), **how) == brute(docs, items,
                                                                                        how.get("top", 20))


def test_blocks_and_ties_keep_the_same_documents(spark, make_docs, case, monkeypatch):
    docs, items = case
    items = items[:6]
    held = ls.Items([t for _, t in items])
    rng = np.random.default_rng(1)
    scores, ids = rng.integers(0, 4, (300, held.size)), rng.permutation(300)
    best = ls.Best(held.size, 20)
    for a in range(0, 300, 7):
        best.add(scores[a: a + 7], (ids[a: a + 7] % 5 == 0).astype(np.int64), ids[a: a + 7])
    for k in range(held.size):
        want = sorted((-s, i % 5 == 0, i) for s, i in zip(scores[:, k], ids) if s)[:20]
        assert [(-s, bool(u), i) for _, s, u, i in best.rows[best.rows[:, 0] == k]] == want


def test_empty_tables(spark, make_docs):
    items = spark.createDataFrame([(1, "a b")], ITEMS)
    assert ranked_search(make_docs([]), items).collect() == []
    assert ranked_search(make_docs(["a b"]), items.limit(0)).collect() == []
    assert ranked_search(make_docs([None, ""]), items).collect() == []

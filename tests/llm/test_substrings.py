import hashlib
import random
import re

import numpy as np
import pytest

from dealbook.llm import substring_dedup as sd
from dealbook.llm.fm_index import WaveletTree, earliest
from dealbook.llm.substring_dedup import remove_repeats


def brute(rows, window=20):
    """(doc_id, text) rows to (doc_id, n_words, n_removed, sha256), by comparing all windows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    place = lambda r, i: (rows[r][0] is None, rows[r][0] or 0, i)
    first = {}
    for r, ws in enumerate(words):
        for i in range(len(ws) - window + 1):
            k = tuple(ws[i: i + window])
            first[k] = min(first.get(k, place(r, i)), place(r, i))
    out = []
    for r, ws in enumerate(words):
        gone = set()
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i: i + window])] < place(r, i):
                gone |= set(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((rows[r][0], len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df, **how):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return sorted(((*r[:3], sha(r.kept_text)) for r in remove_repeats(df, **how).collect()), key=str)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["ñandú", "中文", "A", "a"]
    line = [rng.choice(words) for _ in range(12)]
    passage = [rng.choice(words) for _ in range(70)]
    texts = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.choice([0, 5, 19, 20, 21, 60, 200]))]
        if i % 3 == 0:
            at = rng.randrange(len(t) + 1)
            t[at:at] = line
        if i % 4 == 0:
            at = rng.randrange(len(t) + 1)
            t[at:at] = passage[rng.randrange(20):][: rng.randrange(20, 70)]
        if i % 7 == 0 and texts:
            t = list(rng.choice(texts))
            if t:
                t[rng.randrange(len(t))] = "changed"
        if i % 11 == 0:
            t += ["x", "y", "z"] * 30
        texts.append(t)
    seps = [" ", "\n", "\t", "  ", "\r\n", "\x0b"]
    return [(i, "".join(w + rng.choice(seps) for w in t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("how", [{}, {"hot_segments": 2}, {"shard_bytes": 500, "bucket_bytes": 300}, {"gram": 3, "hot_segments": 4}])
def test_equals_brute_force(make_docs, how):
    rows = corpus()
    assert got(make_docs([(i, t, "en", "s") for i, t in rows], parts=5), **how) == brute(rows)


def test_slices_settle_and_shards_compact_alike(make_docs, monkeypatch):
    rows = corpus(seed=2) + [(100 + i, "one passage " * 3 + " ".join(f"p{j}" for j in range(50))) for i in range(40)]
    want = brute(rows)
    df = make_docs([(i, t, "en", "s") for i, t in rows], parts=4).cache()
    assert got(df) == want
    parts = [pdf for pdf in [df.toPandas().assign(mark=lambda p: p["doc_id"])]]
    import pandas as pd

    monkeypatch.setattr("dealbook.llm.words.SLICE_CHARS", 300)
    dealt = pd.concat(sd.document_grams(iter(parts), 20, 5, 3)).sort_values("bucket", kind="stable")
    told = pd.concat(sd.shared_grams(iter([dealt]), 30))
    assert told["mark"].isna().any() and told.loc[told["mark"].isna(), "n"].min() >= 30
    parts[0]["grams"] = [told.loc[told["mark"] == d, "gram"].to_numpy() for d in parts[0]["mark"]]
    for chars, room in ((50, 200), (2_000_000, 1)):
        monkeypatch.setattr("dealbook.llm.words.SLICE_CHARS", chars)
        monkeypatch.setattr(sd, "INDEX_WORDS", room)
        cut = [r for p in sd.cut_segments(iter(parts), 20, 5, 1, np.empty(0, np.uint64)) for r in p.itertuples()]
        found = pd.concat(sd.search_shards(iter([pd.DataFrame(cut)[["shard", "settled", "words", "meta"]]]), 20))
        removed = {}
        for r in found.itertuples():
            for i in range(r.start, r.start + r.windows):
                removed.setdefault(r.id, set()).update(range(i, i + 20))
        assert {d: len(removed.get(d, ())) for d, *_ in rows} == {w[0]: w[2] for w in want}


def test_null_empty_repeated_clashing_and_very_long(make_docs, clashing):
    line = " ".join(f"q{j}" for j in range(30))
    long = " ".join(f"u{j % 5000}" for j in range(60_000))
    rows = [(None, line), (None, "x " + line), (1, None), (2, ""), (3, " \n\t"), (5, line), (5, line),
            (5, "y " + line), (4, line + " z"), (7, long), (6, "short text")]
    df = clashing(make_docs([(i, t, "en", "s") for i, t in rows]))
    assert got(df) == brute(rows)
    assert remove_repeats(make_docs([])).collect() == []


def test_words_that_go_round_repeat_within_one_segment(make_docs):
    # 21 equal words are two equal windows, and no other segment has their least hash.
    texts = ["a " * 21, "b c " * 11, " ".join(f"d{i % 19}" for i in range(45)), "e " * 20,
             "x " * 39 + "end", " ".join(f"f{i}" for i in range(30)) + " g" * 23]
    rows = list(enumerate(texts))
    want = brute(rows)
    assert [r[2] for r in want] == [20, 20, 26, 0, 38, 22]
    df = make_docs([(i, t, "en", "s") for i, t in rows], parts=3)
    assert got(df) == want and got(df, hot_segments=1) == want


def test_kept_text_is_returned_and_digested(make_docs):
    line = " ".join(f"q{j}" for j in range(25))
    docs = make_docs([line, "a " + line + " b"])
    assert sorted(tuple(r) for r in sd.kept_digests(docs).collect()) == brute([(0, line), (1, "a " + line + " b")])
    out = {r.doc_id: r.kept_text for r in remove_repeats(docs).collect()}
    assert out == {0: line, 1: "a b"}


def test_wavelet_ranks_and_interval_minima():
    rng = np.random.default_rng(3)
    seq = rng.integers(0, 37, 700)
    tree = WaveletTree(seq, 37)
    at, sym = rng.integers(0, 701, 300), rng.integers(0, 37, 300)
    assert tree.rank(sym, at).tolist() == [int((seq[:a] == s).sum()) for a, s in zip(at, sym)]
    text = np.array([1, 2, 1, 2, 1, 0, 2, 1, 2, 0])
    order = np.array([0, 1, 2, 99, 99, 99, 3, 99, 99, 99])
    found = earliest(text, np.array([0, 6]), np.array([5, 3]), order, 3)
    assert found[[0, 1, 2, 6]].tolist() == [0, 1, 0, 1]

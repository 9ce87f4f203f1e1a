import hashlib
import random
import zlib

import pytest

from dealbook.llm.periodic_runs import SuffixAutomaton, candidates, find_runs, run_digests, runs_of, runs_of_texts
from dealbook.llm.words import Words


def brute(w, least_words=6, least_periods=4):
    """Runs by trying every period."""
    out, n = [], len(w)
    for q in range(1, n // least_periods + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            e = i
            while e + 1 < n and w[e + 1] == w[e + 1 - q]:
                e += 1
            s, length = i - q, e - i + q + 1
            part = w[s: e + 1]
            least = next(p for p in range(1, q + 1) if all(part[k] == part[k - p] for k in range(p, length)))
            if least == q and length >= max(least_words, least_periods * q):
                out.append((s, length, q))
            i = e + 1
    return sorted(out)


def periodic_text(rng):
    words = [str(k) for k in range(rng.choice([1, 2, 3, 30, 1000]))]
    out = [rng.choice(words) for _ in range(rng.choice([0, 1, 7, 40, 120]))]
    for _ in range(rng.choice([0, 1, 2])):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 8, 25]))]
        reps = (base * 9)[: rng.randrange(len(base), 9 * len(base) + 1)]
        at = rng.randrange(len(out) + 1)
        out[at:at] = reps
    return out


@pytest.mark.parametrize("bounds", [(6, 4), (2, 2), (1, 3)])
def test_runs_equal_brute_force(bounds):
    rng = random.Random(5)
    for _ in range(400):
        w = periodic_text(rng)
        assert runs_of(w, *bounds) == brute(w, *bounds), w


def test_candidate_ranges_lose_no_run():
    rng = random.Random(6)
    texts = [periodic_text(rng) for _ in range(300)]
    joined = [" \n".join(t) for t in texts]
    assert runs_of_texts(joined) == [brute(t) for t in texts]
    plain = " ".join(str(rng.randrange(10**6)) for _ in range(3000))
    assert candidates(Words([plain])) == []


def test_automaton_accepts_exactly_the_substrings():
    w = list("abacabadab")
    a = SuffixAutomaton(w)
    assert len({"".join(w[i:j]) for i in range(10) for j in range(i, 11)}) - 1 == sum(
        a.length[v] - a.length[a.link[v]] for v in range(1, len(a.length)))


def expected(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()),
            sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_digests_equal_brute_force_on_odd_rows(make_docs, clashing):
    rng = random.Random(7)
    texts = [" ".join(periodic_text(rng)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [
        (None, "a a a a a a a b"), (200, None), (201, ""), (202, " \t\n"), (203, "x y " * 9), (203, "x y " * 9),
        (204, "é ñ 中 文 " * 5), (205, " ".join(str(i % 7000) for i in range(40_000)))]
    df = clashing(make_docs([(i, t, "en", "s") for i, t in rows]))
    out = sorted((tuple(r) for r in run_digests(df).collect()), key=str)
    assert out == sorted((expected(i, t) for i, t in rows), key=str)
    assert run_digests(make_docs([])).collect() == []


def test_runs_and_collapsed_text_are_returned(make_docs):
    (r,) = find_runs(make_docs(["start a b a b a b a b end"])).collect()
    assert [tuple(x) for x in r.runs] == [(1, 8, 2)] and r.collapsed == "start a b end"

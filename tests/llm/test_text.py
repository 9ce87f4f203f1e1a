"""N-gram join, mixing, extraction, language, toxicity and the pipeline."""

import html
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from dealbook.llm import html_extract, language_id, mixing, ngram_join, toxicity
from dealbook.llm.common import components
from dealbook.llm.mixing import TEMPER, mix_sources, mixed_documents
from dealbook.llm.ngram_join import JACCARD_SQL, jaccard_classes, one_per_group
from dealbook.llm.packing import pack

SF = "/root/testdata/sf0.001"


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(7, None), (3, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for i in sorted(near):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in want:
                want[j] = i
                todo += near[j]
    assert got == want


def near_copies():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(60):  # copies of one base with few or many changes
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((100 + i, " ".join(w)))
    rows += [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 90)))) for i in range(40)]
    line = "this very common line stands in many of the documents"
    rows += [(500 + i, f"{line}\n" + " ".join(rng.choice(words) for _ in range(25))) for i in range(30)]
    rows += [(700, "one two"), (701, "One\tTWO"), (702, "one"), (703, ""), (704, None), (705, " \n\x0b "), (706, "a b c"),
             (707, "É é"), (708, "é é"), (None, rows[0][1]), (None, None), (709, "x " * 5000), (710, "x " * 300), (711, "\x85 a b c d e")]
    rows += [(rows[5][0], rows[5][1])]  # a repeated row
    return rows


def brute_classes(rows, percent=85):
    sets = []
    for _, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        sets.append({tuple(w)} if 0 < len(w) < 4 else {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if w else set())
    n = len(rows)
    link = [[bool(sets[i]) and rows[i][0] is not None and rows[j][0] is not None
             and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    component = [None] * n
    for i in sorted((i for i in range(n) if rows[i][0] is not None), key=lambda i: rows[i][0]):
        todo = [i]
        while todo:
            j = todo.pop()
            if component[j] is None:
                component[j] = rows[i][0]
                todo += [k for k in range(n) if link[j][k]]
    return sorted(((r[0], len(s), c) for r, s, c in zip(rows, sets, component)), key=str)


@pytest.mark.parametrize("fragment_bytes,block_sets,fan_out", [(4000, 8, 1024), (300, 8, 3), (24_000_000, 1024, 1024)])
def test_jaccard_classes_equal_brute_force(make_docs, clashing, monkeypatch, fragment_bytes, block_sets, fan_out):
    rows = near_copies()
    monkeypatch.setattr(ngram_join, "HOT_LEAST", 3)
    out = jaccard_classes(clashing(make_docs(rows)), fragment_bytes=fragment_bytes, block_sets=block_sets, fan_out=fan_out)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str)
    assert got == brute_classes(rows)


def test_jaccard_classes_of_a_slice_that_ends_in_empty_texts(spark):
    text = "one two three four five six seven"
    rows = [(1, text), (2, "other words stand in this text here"), (3, text), (4, ""), (5, None), (6, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_classes(docs).collect())
    assert got == sorted(brute_classes(rows)) and got[2] == (3, 4, 1)


def test_jaccard_classes_of_a_repeated_row_just_over_the_threshold(make_docs):
    a = [f"w{i}" for i in range(103)]
    b = a[:95] + [f"v{i}" for i in range(8)]  # 92 of 100 n-grams each are shared
    rows = [(1, " ".join(a)), (2, " ".join(b)), (1, " ".join(a)), (1, " ".join(a))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_classes(make_docs(rows)).collect())
    assert got == [(1, 100, 1)] * 3 + [(2, 100, 1)]


def test_jaccard_classes_of_nothing(make_docs):
    assert jaccard_classes(make_docs([])).collect() == []


def test_jaccard_classes_match_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got = jaccard_classes(spark.read.parquet(f"{SF}/documents.parquet"))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({JACCARD_SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_one_document_of_each_group_stays(make_docs, clashing):
    rows = near_copies()
    docs = clashing(make_docs(rows))
    kept = one_per_group(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    want = {i for i, _, c in brute_classes(rows) if i is not None and i == c}
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 2


def test_near_duplicate_stage_compares_five_words_at_80_percent(spark, make_docs):
    words = [f"w{i}" for i in range(229)]
    changed = [w + "x" if i in (20, 60, 100, 140, 180) else w for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words + [f"v{i}" for i in range(40)])),
            (4, " ".join(f"u{i}" for i in range(50)))]
    kept = corpus_pipeline.near_duplicate_stage(spark, make_docs(rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4]


def test_mixing_meets_its_targets(make_docs, clashing):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alphabet", "betabetabeta", "gammaray", "deltas", "x"]) for _ in range(rng.randint(0, 60))),
             rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)]
    rows += [(1000, None, "en", "a"), (1001, "", "zz", "only"), (None, "some words here", "en", "a")]
    docs = clashing(make_docs(rows))
    got = mix_sources(docs).toPandas()
    assert len(got) == len(rows) and got.probability.between(0, 1).all()
    assert got.set_index("doc_id").n_tokens[1000] == 0
    # Brute-force raking of the same cells.
    cells = got.groupby(["source", "lang", "topic"]).n_tokens.sum()
    cells = cells[cells > 0]
    w = cells.astype(float).copy()
    goals = {}
    for level in ("source", "lang", "topic"):
        share = cells.groupby(level=level).sum() / cells.sum()
        goals[level] = share ** TEMPER[level] / (share ** TEMPER[level]).sum()
    for _ in range(2000):
        for level, goal in goals.items():
            w = w * (goal / w.groupby(level=level).sum()).reindex(w.index.get_level_values(level)).to_numpy()
    ratio = (w / cells * cells.sum()).to_dict()
    for r in got.itertuples():
        key = (r.source, r.lang, r.topic)
        if key in ratio:
            assert abs(r.weight - ratio[key]) < 1e-6 * max(1, ratio[key])
            assert abs(r.probability - ratio[key] / max(ratio.values())) < 1e-6
    expected = (got.probability * got.n_tokens).groupby(got.source).sum()
    assert np.allclose((expected / expected.sum())[goals["source"].index], goals["source"], atol=1e-6)
    kept = mixed_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        str(None if np.isnan(i) else int(i)) for i in got[got.kept].doc_id.astype(float))


@pytest.mark.parametrize("lang,source", [("en", "new"), (None, "a")])
def test_one_stray_row_does_not_empty_the_sample(spark, make_docs, lang, source):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alphabet", "betabetabeta", "gammaray", "deltas"]) for _ in range(rng.randint(100, 140))),
             rng.choice(["en", "en", "de"]), rng.choice(["a", "a", "b", "c"])) for i in range(600)]
    docs = make_docs(rows + [(5000, "alphabet " * 20, lang, source)])
    kept = corpus_pipeline.mixing_stage(spark, docs, "").count()
    assert 0.4 * len(rows) < kept
    got = mix_sources(docs, share=0.5).toPandas()
    assert got.probability.between(0, 1).all() and got.kept.sum() == kept
    expected = got.probability * got.n_tokens
    assert abs(expected.sum() / got.n_tokens.sum() - 0.5) < 1e-6
    assert got.set_index("doc_id").probability[5000] > 0.999  # its target is more than it holds
    for level in ("source", "lang"):  # the others share the rest as their targets say
        size, have = got.n_tokens.groupby(got[level]).sum(), expected.groupby(got[level]).sum()
        free = [v for v in size.index if v not in ("new", "")]
        goal = size[free] ** TEMPER[level]
        assert np.allclose(have[free] / have[free].sum(), goal / goal.sum(), atol=1e-4)


def test_mixing_of_nothing(make_docs):
    assert mix_sources(make_docs([])).collect() == []


@pytest.fixture(scope="module")
def field():
    return html_extract.train()


def test_field_labels_unseen_layouts(field):
    reader, wrong, total = html_extract.Blocks(), 0, 0
    for page in html_extract.labelled_pages(150, seed=4242):
        blocks = reader.read(page)
        labels = field.decode([field.score(p, t, k) for p, t, k, _ in blocks])
        wrong += sum(y != z for (*_, y), z in zip(blocks, labels))
        total += len(blocks)
    assert wrong <= 0.015 * total


def test_viterbi_is_the_best_of_all_sequences(field):
    rng = np.random.default_rng(0)
    for _ in range(20):
        s = rng.normal(scale=2, size=7).tolist()

        def worth(y):
            return (field.start[y[0]] + sum(x for x, k in zip(s, y) if k)
                    + sum(field.trans[a, b] for a, b in zip(y[:-1], y[1:])))

        best = max(worth([n >> i & 1 for i in range(7)]) for n in range(128))
        assert abs(worth(field.decode(s)) - best) < 1e-9


def test_extraction_of_the_table(spark, clashing, field):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract_main_text(clashing(pages), field).collect()}
    for r in pages.collect():
        body = r.html[r.html.index("<article>") + 9:].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id].text == "\n\n".join(x for x in blocks if x)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<nav><a href=x>Home</a></nav>", ""), ("<html><head><script>if (a < b) {", ""),
    ("<article><h1>A &amp; B</h1><p>Some text&nbsp;here, &eacute;.<br>More \n of it.<p>Second, with <i>style</i>.</article><footer>&copy; x</footer>",
     "A & B\n\nSome text here, é. More of it.\n\nSecond, with style."),
    ("<body><header><h1>Site</h1></header><main><h2>Title here</h2><p>One two three, four five.</p>"
     "<div class='comments'><p>I agree, really.</p></div></main><aside>See also</aside>", "Title here\n\nOne two three, four five."),
    ("<article><p>First part, of it.</p><div class='cookie-notice'>We use cookies.</div><form><label>Name</label>"
     "<button>Go</button></form><p>Last part, of it.", "First part, of it.\n\nLast part, of it.")])
def test_extraction_of_known_pages(field, page, text):
    assert html_extract.main_text(page, field, html_extract.Blocks()) == text


@pytest.mark.parametrize("head", [
    "<html><head><script data-main='js/app' src='require.js'></script></head><body>",
    "<html><head><title>T</title>", "<head><meta charset=utf-8><title>T</title><link rel=x href=y>"])
def test_extraction_of_real_heads(field, head):
    page = head + "<article><h1>Title here</h1><p>One two three, four five.</p></article>"
    for reader in (html_extract.Blocks(), html_extract.Blocks(labelled=False)):
        assert html_extract.main_text(page, field, reader) == "Title here\n\nOne two three, four five."


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify_language(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert 250 < len(held) < 420 and (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    net = language_id.train(docs)
    names, scores = net.predict([None, "", "12 ...", "Der und die", "the of and " * 5000, "é"])
    assert names[:3] == ["und"] * 3 and scores[:3].tolist() == [0, 0, 0]
    assert names[3] == "de" and names[4] == "en" and names[5] != "und"
    # Table look-ups by byte pairs equal the plain network.
    x, _, _ = language_id.windows(["the quick brown fox", "ein Haus in der Stadt" * 30])
    assert np.allclose(net.log_probabilities(x), np.log(net._forward(x)[2]), atol=1e-4)


def test_language_gradient(spark):
    rng = np.random.default_rng(0)
    net = language_id.Network(["a", "b", "c"])
    x, y = rng.integers(97, 103, (5, 32)).astype(np.uint8), np.array([0, 1, 2, 1, 0])

    def loss():
        return -np.log(net._forward(x)[2][np.arange(5), y]).mean()

    for p, g in zip(net.parameters(), net.gradients(x, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        held = p[at]
        p[at] = held + 1e-2
        up = loss()
        p[at] = held - 1e-2
        down = loss()
        p[at] = held
        assert abs((up - down) / 2e-2 - g[at]) < 0.05 * abs(g[at]) + 1e-4


def test_language_without_labels(make_docs):
    docs = make_docs([(1, "some text", None, "s"), (2, None, None, "s")])
    assert {(r.lang_pred, r.score) for r in language_id.identify_language(docs).collect()} == {("und", 0.0)}
    assert language_id.identify_language(make_docs([])).collect() == []


def test_toxicity_of_held_out_texts(spark, make_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_toxicity(docs, labels).toPandas().merge(labels.select("doc_id", "toxic").toPandas(), on="doc_id")
    held = got[got.held_out]
    hit = held[held.toxic == 1].predicted.mean()
    false = held[held.toxic == 0].predicted.mean()
    assert hit > 0.85 and false < 0.03
    model = toxicity.train(docs, labels)
    texts = [None, "", "ab", "a moron and an idiot, pathetic trash", "the of and in " * 9000 + "worthless scum stupid loser"]
    together, alone = model.score(texts), [model.score([t])[0] for t in texts]
    assert np.allclose(together, alone) and together[3] > 0.5 and ((0 <= together) & (together <= 1)).all()


def test_toxicity_keeps_every_strong_ngram(spark, make_docs):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1000)) for _ in range(2)]
    docs = make_docs([(i, texts[i % 2]) for i in range(60)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    found = [{int(b) for _, part in toxicity.buckets([t]) for b in part} for t in texts]
    strong = found[0] ^ found[1]  # those of both texts say nothing
    assert len(strong) > 4096 and set(toxicity.train(docs, labels).kept.tolist()) == strong


def test_toxicity_with_one_label(spark, make_docs):
    docs = make_docs([(i, f"text {i}") for i in range(12)] + [(None, None)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)] + [(3, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.score_toxicity(docs, labels).collect()} == {0}
    assert toxicity.score_toxicity(make_docs([]), labels.limit(0)).collect() == []


def test_pipeline_stages(spark, clashing):
    assert "pipeline" in entry.queries() and corpus_pipeline.ORACLE_SQL is None
    docs = clashing(spark.read.parquet(f"{SF}/documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        before, after = ({r.doc_id for r in df.select("doc_id").collect()} for df in (docs, out))
        assert out.columns == docs.columns and after <= before, name
        if name == "ngram_jaccard_join":
            rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
            assert after == {i for i, _, c in brute_classes(rows) if i == c}
        docs = out.cache()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert packed.columns == pack(docs).columns


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.columns[0] == "doc_id"


@pytest.mark.parametrize("html, want", [
    ("<p>One</p><![foo[ x ]]><p>two</p>", ["One", "two"]),
    ("<p>One</p><![ 1 ]><p>two</p>", ["One", "two"]),
    ("<p>One</p><![CDATA[ gone ]]><p>two</p>", ["One", "two"]),
    ("<p>One</p><![if !IE]><p>two</p><![endif]>", ["One", "two"]),
    ("<p>One</p><![foo", ["One"]),
    ("<p>One</p><!x[<p>two</p>", None),
    ('<article><svg class="i"/><p>text</p></article>', ["text"]),
    ("<p>One two <svg/> three.</p>", ["One two three."]),
    ("<p>One <svg><g><path d='1'/><title>no</title></g></svg>two <math><mi>x</mi></math> three</p>", ["One two three"]),
    ("<p>One <svg><g> two</p><p>three</p>", ["One", "three"]),
    ("<div><svg><path><p>out</p></div>", ["out"]),
    ("<div>a<svg><foreignObject><div>no</div></foreignObject></svg>b</div>", ["ab"]),
    ("<form><select><option>x<option>y</form><p>text</p>", ["text"]),
    ("<select><option>x<p>One</p><p>two</p>", ["One", "two"]),
    ("<div><select><optgroup><option>x</select>in</div>", ["in"]),
])
def test_blocks_of_odd_markup(html, want):
    got = [b[1] for b in html_extract.Blocks(labelled=False).read(html)]
    assert want is None or got == want


def test_extraction_of_empty_repeated_and_very_long_pages(spark, field):
    schema = "page_id long, url string, html string"
    assert html_extract.extract_main_text(spark.createDataFrame([], schema), field).collect() == []
    para = "This is a sentence of the article, and it goes on for a while. "
    long = "<html><body><article>" + "".join(f"<p>{para * 8}{i}</p>" for i in range(10_000)) + "</article></body></html>"
    assert len(long) > 5_000_000
    rows = [(1, "u", long), (2, "v", "<p>x</p>"), (2, "v", "<p>x</p>"), (None, None, None)]
    got = html_extract.extract_main_text(spark.createDataFrame(rows, schema).repartition(2), field).collect()
    assert len(got) == 4 and sum(r.page_id == 2 for r in got) == 2
    text = next(r.text for r in got if r.page_id == 1)
    assert text.count("\n\n") == 9_999 and text.endswith("9999")


@pytest.mark.parametrize("text, letter", [("½ ²", False), ("①", False), ("Ⅷ 8 _", False), ("", False), (None, False),
                                          ("1a", True), ("ñ", True), ("中", True)])
def test_signs_of_numbers_are_no_letters(text, letter):
    assert language_id.has_letter(text) is letter


@pytest.mark.parametrize("percent", [0, 45, 50, 101])
def test_jaccard_refuses_thresholds_it_cannot_hold(make_docs, percent):
    with pytest.raises(ValueError):
        jaccard_classes(make_docs(["a b c d e"]), percent=percent)


def test_rows_of_the_cut_do_not_grow_with_the_fragments(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(3000)) for _ in range(20)]
    pdf = pd.DataFrame({"doc_id": range(20), "text": texts})
    cut = {}
    for fragments in (32, 1024, 62_500):
        step = -(-fragments // ngram_join.FAN_OUT)
        rows = pd.concat(ngram_join.segments(iter([pdf] * 3), 4, fragments, step))
        assert len(rows) <= 3 * ngram_join.FAN_OUT
        if step > 1:
            rows = pd.concat(ngram_join.split_segments(iter([rows.sort_values("frag", kind="stable")]), fragments, step))
        cut[fragments] = rows
    # The same n-grams, whatever the cut; copies of a set in other slices are all there, none is shared in its slice.
    assert {f: sum(len(t) // 4 for t in rows["tokens"]) for f, rows in cut.items()} == dict.fromkeys(cut, 3 * 20 * 2997)
    assert all(sum(len(d) // 40 for d in rows["docs"]) == 60 for rows in cut.values())


def test_an_ngram_of_many_sets_leaves_a_slice_once():
    line = "one line that very many texts have in common here"
    texts = [f"{line} {i} a{i} b{i} c{i}" for i in range(500)]
    (rows,) = list(ngram_join.segments(iter([pd.DataFrame({"doc_id": range(500), "text": texts})]), 4, 1, 1))
    assert len(rows["many"][0]) // 4 == 7
    told = np.frombuffer(rows["told"][0], np.int64).reshape(-1, 3)
    assert len(told) == 500 and (told[:, 2] == 7).all() and (told[:, 1] == 11).all()
    out = ngram_join.shared_counts(rows, 3)
    assert out["bucket"].isna().sum() == 500 and out["bucket"].dropna().tolist() == [0, 1, 2]
    assert sum(len(t) // 24 for t in out["told"].dropna()) == 500


def planted_topics(rng, n=240, topics=4):
    words = [[f"topic{k}word{i:03d}" for i in range(60)] for k in range(topics)]
    shared = [f"everywhere{i:03d}" for i in range(200)]
    own = [rng.randrange(topics) for _ in range(n)]
    return own, [" ".join(rng.choice(words[k]) if rng.random() < 0.4 else rng.choice(shared) for _ in range(80)) for k in own]


def purity(own, found):
    pairs = Counter(zip(own, found))
    return sum(max(c for (_, f), c in pairs.items() if f == g) for g in set(found)) / len(own)


def test_learned_topics_beat_a_hash_of_the_words(make_docs):
    own, texts = planted_topics(random.Random(1))
    got = {r.doc_id: r.topic for r in mix_sources(make_docs(texts)).collect()}
    by_hash = [Counter(hash(w) % 8 for w in t.split()).most_common(1)[0][0] for t in texts]
    assert purity(own, [got[i] for i in range(len(texts))]) > 0.95 > purity(own, by_hash) + 0.3


def test_topics_are_learned_from_all_texts(make_docs):
    rng = random.Random(3)
    words = [f"topicword{i:03d}" for i in range(300)]
    texts = [" ".join(rng.choice(words[k * 60: k * 60 + 90]) for _ in range(rng.randint(3, 20)))
             for k in (rng.randrange(4) for _ in range(4_000))]
    texts += ["", None, "no long word", *texts[:500]]
    docs = make_docs(texts)
    told = mixing.learn_topics(docs)
    draws = {r.text: r.d for r in docs.where("text is not null").select("text", F.xxhash64(F.lit(5), "text").alias("d")).collect()}
    order = sorted(draws, key=lambda t: draws[t] % (1 << 64))
    x = np.log1p(np.concatenate([mixing._term_counts(*p) for p in mixing._parts(order)]))
    x = x[x.any(axis=1)]
    weights = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0)))
    assert len(x) > 3_900 and np.allclose(told.weights, weights, rtol=1e-12)
    x = x * weights / np.linalg.norm(x * weights, axis=1, keepdims=True)
    centres = x[:1]
    while len(centres) < mixing.TOPICS:
        centres = np.vstack((centres, x[np.round((x @ centres.T).max(axis=1), 9).argmin()]))
    for _ in range(mixing.TOPIC_ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.vstack([x[own == k].sum(axis=0) if (own == k).any() else c for k, c in enumerate(centres)])
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    assert np.allclose(told.centres, centres, atol=1e-3)
    again = mixing.learn_topics(docs.repartition(5))
    assert (again.centres == told.centres).all() and (again.weights == told.weights).all()


def test_mixing_takes_each_text_to_words_once(spark, make_docs):
    texts = [*planted_topics(random.Random(2), n=60)[1], "", None, "no long word"]
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    docs = make_docs(texts).withColumn("text", counted.asNondeterministic()("text"))
    got = mix_sources(docs)
    assert read.value == len(texts)
    plain = {r.doc_id: r for r in mix_sources(make_docs(texts)).collect()}
    assert read.value == len(texts) and {r.doc_id: r for r in got.collect()} == plain
    read.value = 0
    kept = mixed_documents(docs).collect()  # once for the fit, once for the rows
    assert read.value == 2 * len(texts) and sorted(r.doc_id for r in kept) == sorted(i for i, r in plain.items() if r.kept)


def test_the_nearest_centre_does_not_depend_on_the_block():
    rng = np.random.default_rng(8)
    centres = rng.random((6, mixing.TOPIC_PLACES)) * (rng.random((6, mixing.TOPIC_PLACES)) < 0.2)
    centres[4] = centres[1]  # all ties between them go to the first
    size = rng.integers(1, 40, 700)
    place = np.concatenate([np.sort(rng.choice(mixing.TOPIC_PLACES, n, replace=False)) for n in size])
    x, first = rng.random(size.sum()), np.cumsum(size) - size
    own = [np.add.reduceat(x[a:a + n, None] * centres.T[place[a:a + n]], [0], axis=0)[0].argmax() for a, n in zip(first, size)]
    assert mixing._nearest(first, place, x, centres).tolist() == own and 4 not in own and 1 in own
    for a, n in zip(first, size):
        assert mixing._nearest(np.array([0]), place[a:a + n], x[a:a + n], centres)[0] == own[0]
        own = own[1:]
    counts = np.array([0, 3, 0, 5_000])  # texts without terms, counts beyond the table of logarithms
    topics = mixing.Topics(np.ones(mixing.TOPIC_PLACES), np.eye(mixing.TOPIC_PLACES)[[7, 9]])
    assert topics.of(np.array([0, 1, 0, 2]), np.array([9, 7, 9]), np.array([3, 40, 5_000])).tolist() == [0, 1, 0, 1]
    assert (mixing._damped(counts) == np.log1p(counts)).all()


def test_mixing_with_very_many_languages_says_how_it_fits(make_docs):
    docs = make_docs([(i, "alphabet betabetabeta " * 5, f"lang{i % 3}" if i % 2 else f"odd{i}", f"s{i % 3}") for i in range(20_000)])
    got = mix_sources(docs, share=0.5).toPandas()
    assert len(got) == 20_000 and got.lang.nunique() > 10_000
    assert got.fit.nunique() == 1 and got.fit[0] in ("raked", "capped") and 0 <= got.fit_error[0] < 0.05
    odd = got[got.lang.str.startswith("odd") & (got.lang != "odd0")]
    assert odd.probability.round(9).nunique() <= 30
    assert 0.45 < (got.probability * got.n_tokens).sum() / got.n_tokens.sum()


def test_mixing_of_repeated_rows(make_docs):
    rows = [(1, "alphabet words", "en", "a")] * 40 + [(2, "deltas of words", "de", "b")] * 5 + [(3, "x", "en", "b")]
    got = mix_sources(make_docs(rows)).toPandas()
    assert len(got) == 46 and got.groupby("doc_id").kept.nunique().max() == 1


def test_stages_without_anything_learned_keep_all(spark, make_docs, clashing):
    rows = [(i, t, None, "s") for i, t in enumerate(["some text", "more text 2", "1 2 ½", "", None, "some text"])]
    docs = clashing(make_docs(rows))
    kept = language_id.known_language_documents(docs, docs)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 5] and kept.columns == docs.columns
    for labels in ([], [(0, 1, 1)], [(0, 1, 0), (1, 0, 0)]):
        labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        assert toxicity.clean_documents(docs, docs, labels).count() == 6
    empty = make_docs([])
    assert language_id.known_language_documents(empty, empty).collect() == []
    assert toxicity.clean_documents(empty, empty, labels).collect() == []


def test_toxicity_weights_equal_a_plain_fit(spark, make_docs):
    import zlib

    rng = random.Random(11)
    words = ["apple", "river", "stone", "cloud", "trash", "scum", "idiot", "green"]
    texts = [" ".join(rng.choice(words[:5] if i % 2 else words[3:]) for _ in range(rng.randint(3, 9))) for i in range(80)]
    docs = make_docs(texts)
    labels = spark.createDataFrame([(i, 1, 1 - i % 2) for i in range(80)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    # The same by loops: features by documents, ratios, strengths, scaled rows.
    rows = [(i, t, 1 - i % 2) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5]
    grams = [{int(b) for _, part in toxicity.buckets([t]) for b in part} for _, t, _ in rows]
    n = [sum(y == k for *_, y in rows) for k in (0, 1)]
    ratio = {}
    for g in sorted(set().union(*grams)):
        c = [sum(y == k and g in own for (*_, y), own in zip(rows, grams)) for k in (0, 1)]
        cells = [(c[k], sum(c) * n[k] / sum(n)) for k in (0, 1)]
        cells += [(n[k] - c[k], (sum(n) - sum(c)) * n[k] / sum(n)) for k in (0, 1)]
        if sum(c) >= 3 and sum(f * np.log(f / e) for f, e in cells if f) >= toxicity.MIN_STRENGTH:
            ratio[g] = np.log((c[1] + 0.5) / (n[1] + 1)) - np.log((c[0] + 0.5) / (n[0] + 1))
    assert model.kept.tolist() == list(ratio)
    place = {g: i for i, g in enumerate(ratio)}
    feats = [sorted(place[g] for g in own if g in place) for own in grams]
    r, y = np.array(list(ratio.values())), np.array([y for *_, y in rows])
    w, b = toxicity.fit_logistic(np.array([len(f) for f in feats]), np.array(sum(feats, []), dtype=np.int32), r, y)
    assert np.allclose(model.weights, w * r, atol=1e-9) and abs(model.intercept - b) < 1e-9
    dense = np.zeros((len(rows), r.size))
    for k, f in enumerate(feats):
        dense[k, f] = 1
    plain = 1 / (1 + np.exp(-(dense @ (w * r) + b)))
    assert np.allclose(model.score([t for _, t, _ in rows]), plain)


def test_language_scores_equal_the_plain_network(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = language_id.train(docs)
    texts = [r.text for r in docs.limit(12).collect()] + ["", "1 2", "é" * 700]
    names, scores = net.predict(texts)
    for text, name, score in zip(texts, names, scores):
        raw = text.lower().encode()
        if not any(c.isalpha() for c in text):
            assert (name, score) == ("und", 0.0)
            continue
        total = np.zeros(len(net.languages))
        for at in range(0, len(raw), language_id.WINDOW):
            part = raw[at: at + language_id.WINDOW]
            x = np.frombuffer(part.ljust(language_id.WINDOW), np.uint8)
            peaks = [np.array([sum(table[k][x[j + k]] for k in range(w)) for j in range(language_id.WINDOW - w + 1)]).max(axis=0)
                     for w, table in net.filters.items()]
            logits = np.maximum(np.concatenate(peaks) + net.bias, 0) @ net.dense + net.out
            total += len(part) * (logits - np.log(np.exp(logits).sum()))
        p = np.exp(total / len(raw) - (total / len(raw)).max())
        assert name == net.languages[int(p.argmax())] and abs(score - (p / p.sum()).max()) < 1e-4

"""Tokenizer, best-fit packing, training order and sharding."""

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dealbook.llm import training_order
from dealbook.llm.packing import best_fit, pack
from dealbook.llm.sharding import communication_matrix, hypergeometric_sql, placed, shuffle_into_shards, uniform_sql
from dealbook.llm.tokens import encoder
from dealbook.llm.training_order import dealt_by_shard, feistel, materialise, read_shard, record_size

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TEXTS = ["", None, "a", "a  b\n\n c", "it's we'll 's don't", "日本語 ½ x²", "x<|endoftext|>y", "\x85 　z", "word " * 3000,
         "the the the", "the the the", " ", "\n", "Ünïcode\t\ttabs 12345 !!"] + [f"text number {i} " * (i % 40) for i in range(150)]


def reference_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab' \n\tsétre 　½9.,!<|>🙂日"))), max_size=6))
def test_encoder_equals_the_tokenizer_file(texts):
    assert [x.tolist() for x in encoder().encode(texts)] == [reference_ids(t) for t in texts]


def test_encoder_on_known_texts():
    assert [x.tolist() for x in encoder().encode(TEXTS)] == [reference_ids(t) for t in TEXTS]


def test_best_fit_holds_its_bounds():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 100, 3000)
    bins = best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    filled = [sizes[b].sum() for b in bins]
    assert max(filled) <= 100 and sum(f <= 50 for f in filled) <= 1
    assert len(bins) <= 1.03 * -(-sizes.sum() // 100)


@pytest.mark.parametrize("group_items", [20, 60_000])
def test_packing_round_trip(make_docs, clashing, group_items):
    docs = clashing(make_docs(TEXTS + [(None, "no id"), (5, TEXTS[5])]))
    rows = pack(docs, limit=64, group_items=group_items).collect()
    ids = {}
    for i, t in [*enumerate(TEXTS), (None, "no id")]:
        ids[i] = np.array(reference_ids(t) + [0], dtype="<u4")
    seen = Counter()
    for r in rows:
        part = ids[r.doc_id][r.start: r.start + r.length]
        assert r.length == part.size <= 64 and zlib.crc32(part.tobytes()) == r.ids_crc32
        assert r.start == (0 if r.piece == 0 else ids[r.doc_id].size - 64 * (-(-ids[r.doc_id].size // 64) - r.piece))
        seen[r.doc_id] += r.length
    assert seen == Counter({i: x.size * (2 if i == 5 else 1) for i, x in ids.items()})
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= 1.1 * -(-sum(seen.values()) // 64) + 1


def test_packing_of_nothing(make_docs):
    assert pack(make_docs([])).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    slots = feistel(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    if n >= 1000:
        assert not np.array_equal(slots, feistel(np.arange(n), n, key=1))
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.15


def test_training_order_round_trip(spark, make_docs, clashing, tmp_path):
    docs = clashing(make_docs(TEXTS))
    path = str(tmp_path / "shards")
    rows = sorted(materialise(docs, length=32, shard_sequences=40, row_sequences=8, path=path).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(len(rows))) == sorted(r.sequence for r in rows)
    content = {}
    for shard in range(rows[-1].shard + 1):
        got = read_shard(spark, path, shard, length=32).collect()
        mine = [r for r in rows if r.shard == shard]
        assert [len(g.ids) for g in got] == [r.n_tokens for r in mine]
        assert [zlib.crc32(np.array(g.ids, "<u4").tobytes()) for g in got] == [r.ids_crc32 for r in mine]
        assert [r.byte_offset for r in mine] == [i * record_size(32) for i in range(len(mine))]
        content |= {r.sequence: list(g.ids) for r, g in zip(mine, got)}
        tail = read_shard(spark, path, shard, from_slot=len(mine) - 1, length=32).collect()
        assert [t.ids for t in tail] == [got[-1].ids]
    # The sequences in their first order are the documents, each closed by id 0.
    stream = [x for s in sorted(content) for x in content[s]]
    assert Counter(stream) == Counter(x for t in TEXTS for x in [*reference_ids(t), 0])
    assert {d for r in rows for d in r.doc_ids} == set(range(len(TEXTS)))


def test_training_order_of_nothing(make_docs, tmp_path):
    assert materialise(make_docs([]), path=str(tmp_path / "none")).collect() == []


def test_hypergeometric_law(spark):
    draws = spark.range(20_000).select(F.expr(hypergeometric_sql("30L", "100L", "20L", uniform_sql("id"))).alias("k"))
    counts = Counter(r.k for r in draws.collect())
    from math import comb

    for k in range(2, 11):
        p = comb(30, k) * comb(70, 20 - k) / comb(100, 20)
        assert abs(counts[k] / 20_000 - p) < 5 * (p / 20_000) ** 0.5
    edge = spark.sql("SELECT " + ", ".join(f"{hypergeometric_sql(g, t, n, '0.7D')} AS c{i}" for i, (g, t, n) in enumerate(
        [("0L", "0L", "0L"), ("5L", "5L", "5L"), ("5L", "9L", "0L"), ("0L", "9L", "4L"), ("4L", "6L", "6L")])))
    assert list(edge.first()) == [0, 5, 0, 0, 4]


@pytest.mark.parametrize("rows", [0, 1, 7, 163])
def test_shards_are_exact(make_docs, clashing, rows):
    texts = (TEXTS + [(None, "x"), (5, TEXTS[5])])[:rows]
    out = shuffle_into_shards(clashing(make_docs(texts)), shards=5, block_rows=16).collect()
    assert len(out) == rows
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        text = TEXTS[r.doc_id] if r.doc_id is not None else "x"
        assert r.size == len((text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((text or "").encode())
        assert r.law == "rows" and r.grown_shard is None
    sizes = [len(slots.get(s, [])) for s in range(5)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def naive_best_fit(sizes, limit):
    """Largest first, each into the bin of least room that holds it."""
    room = []
    for size in sorted(sizes, reverse=True):
        fits = [(r, b) for b, r in enumerate(room) if r >= size]
        if fits:
            room[min(fits)[1]] -= size
        else:
            room.append(limit - size)
    return sorted(limit - r for r in room)


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_equals_the_naive_one(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, (100, 60, 20, 101, 8)[seed], 400)
    assert sorted(int(sizes[b].sum()) for b in best_fit(sizes, 100)) == naive_best_fit(sizes.tolist(), 100)


def test_rounds_fill_the_sequences(make_docs):
    docs = make_docs(["one two three " * (k % 8) for k in range(900)], parts=7)
    rows = pack(docs, limit=64, group_items=30).collect()
    filled = Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    total = sum(filled.values())
    assert max(filled.values()) <= 64 and len(filled) <= 1.08 * -(-total // 64)


def test_equal_rows_spread_over_all_blocks(make_docs):
    docs = make_docs([(5, "same")] * 40_000, parts=3)
    sizes = [r["count"] for r in placed(docs, 40, 7).groupBy("block").count().collect()]
    assert len(sizes) == 40 and max(sizes) < 1300
    out = shuffle_into_shards(docs, shards=4, block_rows=1000).groupBy("shard").agg(
        F.count("*").alias("n"), F.count_distinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert [(r.n, r.d, r.m) for r in out] == [(10_000, 10_000, 9_999)] * 4


def test_matrix_has_the_sums_of_blocks_and_shards(spark):
    rows = [13, 0, 40, 7, 25, 15]
    blocks = spark.createDataFrame([(b, n) for b, n in enumerate(rows) if n], "block long, n long")
    drawn = {r.block: r.counts for r in communication_matrix(blocks, 6, 7, 100, 3).collect()}
    assert [sum(drawn[b]) if b in drawn else 0 for b in range(6)] == rows
    assert [sum(c[j] for c in drawn.values()) for j in range(7)] == [15, 15, 14, 14, 14, 14, 14]


@pytest.mark.parametrize("shards", [1, 21, 1229])
def test_shards_are_dealt_evenly(spark, shards):
    df = dealt_by_shard(spark.range(shards * 3).selectExpr(f"cast(id % {shards} as int) as shard"), shards)
    per_task = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count_distinct("shard").alias("n")).collect()]
    assert len(per_task) == shards and max(per_task) == 1
    grouped = df.groupBy("shard").applyInPandas(lambda g: g, "shard int")
    assert grouped._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_wide_vocabularies_are_refused(monkeypatch):
    class Wide:
        def encode(self, texts):
            return [np.array([70_000], np.uint32) for _ in texts]

    monkeypatch.setattr(training_order, "encoder", lambda name: Wide())
    monkeypatch.setattr(training_order, "TaskContext", type("C", (), {"get": staticmethod(lambda: type("T", (), {
        "partitionId": staticmethod(lambda: 0)}))}))
    with pytest.raises(ValueError, match="70000"):
        list(training_order.sequences(iter([pd.DataFrame({"doc_id": [1], "text": ["x"]})]), "wide", 8, 8))


def test_training_order_with_a_null_id(make_docs, tmp_path):
    rows = materialise(make_docs([(None, "a b"), (None, "c"), (3, None)], parts=1), length=4, path=str(tmp_path / "s")).collect()
    assert sorted(d for r in rows for d in r.doc_ids) .count(-1) >= 2 and any(3 in r.doc_ids for r in rows)

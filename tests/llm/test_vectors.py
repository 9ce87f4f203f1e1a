"""Metric range join and exact top-k against brute force."""

import duckdb
import numpy as np
import pytest

from dealbook.llm.metric_join import NEAR_DUPLICATES_SQL, near_duplicates
from dealbook.llm.topk_search import TOP_K_SQL, top_k_search

SCHEMA = "vec_id long, embedding array<float>, label int"
SF = "/root/testdata/sf0.001"


def fixture_rows():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 8))
    rows = [(i, (base[i % 12] + rng.normal(scale=0.12 * (i % 4), size=8)).astype(np.float32).tolist(), 0) for i in range(120)]
    rows += [(200 + i, rows[3][1], 1) for i in range(30)]  # copies
    rows += [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] + [1.0] * 7, 0), (303, [float("inf")] + [1.0] * 7, 0),
             (304, [None] + [1.0] * 7, 0), (305, [], 0), (306, [1.0, 2.0, 3.0], 0), (307, [1.0, 2.0, 3.001], 0),
             (320, [-0.0] * 7 + [1.0], 0), (340, [0.0] * 7 + [1.0], 0), (None, rows[3][1], 0)]
    return rows


def brute_links(rows, threshold=0.95):
    ok = [(i, np.array(v, dtype=float)) for i, v, _ in rows
          if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i, _, _ in rows if i is not None}
    for a, x in ok:
        for b, y in ok:
            if a != b and x.size == y.size and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a].add(b)
    component = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in component:
                component[j] = i
                todo += links[j]
    return {i: (len(links[i]), component[i], component[i] == i) for i in links}


@pytest.mark.parametrize("block,pivots", [(16, 6), (8192, 2048)])
def test_metric_join_equals_brute_force(spark, clashing, block, pivots):
    rows = fixture_rows()
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(4))
    out = near_duplicates(df, block=block, max_pivots=pivots)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.collect()}
    assert got.pop(None) == (0, None, False)
    assert got == brute_links(rows)


def test_metric_join_keeps_the_invalid_rows_of_an_id(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (2, None, 0), (2, [0.0, 0.0], 0), (2, [float("nan"), 1.0], 0), (3, None, 0)]
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1, 1, True)] + [(2, 0, 1, False)] * 3 + [(2, 1, 1, False), (3, 0, 3, True)]


def test_metric_join_of_nothing(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_top_k_equals_brute_force(spark, clashing):
    rows = [r for r in fixture_rows() if r[0] != 306 and r[0] != 307]
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(4))
    got = {}
    for r in top_k_search(df, candidate_block=32, query_block=4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    valid = {i: np.floor(64 * np.array(v, dtype=float)).astype(int) for i, v, _ in rows
             if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = {}
    for q, w in valid.items():
        if q % 20 == 0:
            scored = sorted((-int((w[:c.size] * c[:w.size]).sum()) if w.size == c.size else 0, i) for i, c in valid.items() if i != q)
            want[q] = {k + 1: (i, -s) for k, (s, i) in enumerate(scored[:20])}
    assert got == want


def test_top_k_of_little(spark):
    assert top_k_search(spark.createDataFrame([], SCHEMA)).collect() == []
    few = spark.createDataFrame([(20, [1.0, 2.0], 0), (1, [3e9, 1.0], 0)], SCHEMA)
    assert [tuple(r) for r in top_k_search(few).collect()] == [(20, 1, 1, 64 * 64 * 3_000_000_000 + 64 * 128)]


@pytest.mark.parametrize("query,sql", [(near_duplicates, NEAR_DUPLICATES_SQL), (top_k_search, TOP_K_SQL)])
def test_vector_queries_match_sql(spark, query, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    got = query(spark.read.parquet(f"{SF}/embeddings.parquet"))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def _same_as_sql(spark, rows, op, sql):
    import pyarrow as pa

    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": [r[0] for r in rows],
                                         "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float64()))}))
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "vec_id long, embedding array<double>")
    out = op(df.repartition(3))
    want = con.execute(sql).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(tuple(r) for r in out.select(*names).collect()) == sorted(want)
    return sorted(tuple(r) for r in out.collect())


def test_metric_join_of_two_vectors_of_one_id(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, a), (5, b), (1, [1.0, 0.01, 0.0]), (2, [0.01, 1.0, 0.0]), (3, [0.0, 1.0, 0.01]), (9, [0.0, 0.0, 1.0]),
            (9, [0.0, 0.0, 1.0]), (7, [0.0, 0.0, 2.0])]
    got = _same_as_sql(spark, rows, near_duplicates, NEAR_DUPLICATES_SQL)
    assert [r[:3] for r in got if r[0] == 5] == [(5, 1, 1), (5, 2, 1)]
    assert [r[:3] for r in got if r[0] in (2, 7)] == [(2, 2, 1), (7, 2, 7)]


def test_top_k_lists_every_equal_row(spark):
    rows = [(20, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [0.5, 0.25]), (40, [0.0, 1.0]), (40, [1.0, 0.0])]
    got = _same_as_sql(spark, rows, top_k_search, TOP_K_SQL)
    assert [r[2] for r in got if r[0] == 20] == [1, 1, 40, 40, 2] or len([r for r in got if r[0] == 20]) == 5
    assert len([r for r in got if r[0] == 40]) == 8


def test_top_k_of_components_of_any_finite_size(spark):
    import math
    from fractions import Fraction

    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(60)]
    rows += [(100, [1e30, 0.0, 1.0]), (101, [-1e300, 1e-3, 0.0]), (120, [1.7e308, 0.5, 0.0]), (121, [3e9, 2.0**60, 1.0])]
    ints = [(i, [math.floor(Fraction(x) * 64) for x in v]) for i, v in rows]
    want = {}
    for q, w in ints:
        if q % 20 == 0:
            scored = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(w, v)))), c) for c, v in ints if c != q)
            want[q] = [(c, -s) for s, c in scored[:20]]
    got = {}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for r in sorted(top_k_search(df, candidate_block=16, query_block=2).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want

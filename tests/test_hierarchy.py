"""Closure-based totals against a recursive evaluation of the statement rules and hand-made tables."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from dealbook.plans import statement

TEMPLATE_SCHEMA = "n int, concept string, category string, parent string, ratio string"
LEAF_SCHEMA = "category string, month int, value double"


def expected_values(template, leaf):
    """Values by recursion: a total's worth, seen from a place in the template, is its children's worth seen from its row."""
    posted = defaultdict(float)
    for code, month, v in leaf:
        if month is not None:
            posted[code, str(month)] += v
            posted[code, "Total"] += v
    rows = [(float("inf") if n is None else n, code, parent) for n, _, code, parent, _ in template]
    periods = {p for _, p in posted}

    def worth(code, seen_from, period):
        own = [n for n, c, _ in rows if c == code and c.startswith("T") and n < seen_from]
        if not own:
            return posted[code, period]
        return sum(worth(c, max(own), period) for _, c, parent in rows if parent == code)

    codes = {c for _, c, _ in rows} | {c for c, _ in posted}
    after_all = float("inf")
    out = {}
    for code in codes:
        for p in periods:
            mine = [n for n, c, _ in rows if c == code and c.startswith("T")]
            out[code, p] = (sum(worth(c, max(mine), p) for _, c, parent in rows if parent == code)
                            if mine else worth(code, after_all, p))
    return out


def spark_values(spark, template, leaf):
    t = spark.createDataFrame(template, TEMPLATE_SCHEMA)
    lf = spark.createDataFrame(leaf, LEAF_SCHEMA)
    got = statement.statement_values(spark, lf, t).collect()
    return {(r.category, r.period): r.value for r in got if r.category != statement.MARKER}


def assert_same(expected, got):
    keys = set(expected) | set(got)
    for k in keys:
        assert abs(expected.get(k, 0) - got.get(k, 0)) < 1e-6, (k, expected.get(k), got.get(k))


def test_forward_child_total_counts_its_postings(spark):
    # T2 (n=1) has child total T1 whose row comes later (n=3): T1 contributes its
    # own postings, not its computed value.
    template = [(1, "a", "T2", None, None), (2, "b", "A1", "T1", None), (3, "c", "T1", "T2", None)]
    leaf = [("A1", 1, 10.0), ("T1", 1, 3.0)]
    got = spark_values(spark, template, leaf)
    assert got[("T2", "1")] == 3.0
    assert got[("T1", "1")] == 10.0
    assert_same(expected_values(template, leaf), got)


def test_null_n_sorts_last(spark):
    # T1 has no position (unparsable n): it is computed after T2, so T2 sees
    # T1's own postings; a leaf with NULL n is still a child.
    template = [(None, "a", "T1", "T2", None), (1, "b", "A1", "T1", None), (None, "c", "A2", "T2", None),
                (2, "d", "T2", None, None)]
    leaf = [("A1", 1, 10.0), ("A2", 1, 1.0), ("T1", 1, 100.0)]
    got = spark_values(spark, template, leaf)
    assert got[("T2", "1")] == 101.0 and got[("T1", "1")] == 10.0
    assert_same(expected_values(template, leaf), got)


def test_duplicated_child_counts_twice(spark):
    template = [(1, "a", "A1", "T1", None), (2, "b", "A1", "T1", None), (3, "c", "T1", None, None)]
    leaf = [("A1", 1, 5.0), ("A1", 2, 1.0)]
    got = spark_values(spark, template, leaf)
    assert got[("T1", "1")] == 10.0 and got[("T1", "Total")] == 12.0


def random_template(rng, rows):
    cats = []
    out = []
    for n in range(1, rows + 1):
        is_total = rng.random() < 0.35
        cat = f"T{n}" if is_total else f"A{n}"
        cats.append(cat)
        out.append([n, f"c{n}", cat, None, None])
    totals = [c for c in cats if c.startswith("T")] or ["T0"]
    for row in out:
        if rng.random() < 0.9:
            row[3] = rng.choice(totals)
    rng.shuffle(out)
    return [tuple(r) for r in out]


def test_closure_matches_recursion_on_random_templates(spark):
    for seed in range(4):
        rng = random.Random(seed)
        template = random_template(rng, rng.randint(8, 40))
        codes = [r[2] for r in template] + ["X1"]
        leaf = [(rng.choice(codes), rng.randint(1, 12), float(rng.randint(-100, 100))) for _ in range(200)]
        leaf.append(("A1", None, 7.0))
        assert_same(expected_values(template, leaf), spark_values(spark, template, leaf))


def test_long_chain_of_totals(spark):
    template = [(i, "x", f"T{i}", f"T{i + 1}", None) for i in range(1, 151)] + [(0, "leaf", "A1", "T1", None)]
    got = spark_values(spark, template, [("A1", 1, 2.0)])
    assert got[("T150", "1")] == 2.0


def test_template_rewritten_in_place(spark):
    import tempfile

    path = tempfile.mkdtemp(prefix="dealbook-test-") + "/t"
    leaf = spark.createDataFrame([("A1", 1, 10.0), ("A2", 1, 1.0)], LEAF_SCHEMA)
    totals = []
    for rows in ([(1, "a", "A1", "T1", None), (2, "t", "T1", None, None)],
                 [(1, "a", "A1", "T1", None), (3, "b", "A2", "T1", None), (4, "t", "T1", None, None)]):
        spark.createDataFrame(rows, TEMPLATE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)
        template = spark.read.schema(TEMPLATE_SCHEMA).parquet(path)
        got = statement.statement_values(spark, leaf, template).where("category = 'T1' and period = '1'").first()
        totals.append(got.value)
    assert totals == [10.0, 11.0]


def test_root_equals_sum_of_leaves(spark, tables):
    long = statement.pnl_long(spark, tables.ledger, tables.statement_template, "EUROPE", 1997)
    tot = {r.category: r.value for r in long.where(F.col("period") == "Total").collect()}
    leaves = ["A2", "A3", "A4", "A5", "A6", "A7", "A8", "A9", "A10", "A11", "A12"]
    assert abs(tot["T18"] - sum(tot[c] for c in leaves)) < 1e-6


def test_totals_in_two_lines_are_counted_not_enumerated(spark):
    import time

    # 30 levels, each total in two rows of the next: 2**29 paths to the leaf.
    lines, n = [(1, "leaf", "A1", "T0", None)], 2
    for level in range(30):
        for _ in range(2):
            lines.append((n, f"total {level}", f"T{level}", f"T{level + 1}", None))
            n += 1
    began = time.time()
    got = spark_values(spark, lines, [("A1", 1, 2.0), ("T99", 1, 7.0)])
    assert time.time() - began < 20
    assert got["T0", "1"] == 2.0 and got["T29", "1"] == 2.0 * 2**29 and got["T99", "Total"] == 7.0


def test_counts_take_no_time_and_refuse_to_overflow():
    import time

    import pytest

    from dealbook.operators.hierarchy import path_counts

    lines, n = [(1, "A1", "T0")], 2
    for level in range(30):
        lines += [(n + k, f"T{level}", f"T{level + 1}") for k in range(2)]
        n += 2
    began = time.time()
    assert path_counts(lines)["T29"] == {"A1": 2**29}
    assert time.time() - began < 1
    with pytest.raises(ValueError):
        path_counts([(1, "A1", "T0")] + [(k + 2, f"T{k // 2}", f"T{k // 2 + 1}") for k in range(200)])


def test_exact_money_keeps_its_cents(spark):
    t = spark.createDataFrame([(1, "a", "A1", "T1", None), (2, "t", "T1", None, None)], TEMPLATE_SCHEMA)
    leaf = spark.sql("SELECT 'A1' AS category, 1 AS month, CAST('12345678901234567890123456.78' AS DECIMAL(28,2)) AS value")
    got = {(r.category, r.period): str(r.value) for r in statement.statement_values(spark, leaf, t).collect()}
    assert got["T1", "1"] == got["A1", "Total"] == "12345678901234567890123456.78"

"""Property tests: functions against their specification / DuckDB on generated inputs."""

import duckdb
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from dealbook import functions as D
from dealbook.operators.distinct import two_level_aggregate


RATIO_TEXTS = [
    (None, []), ("", []), ("A1", []), ("A2/A1", ["A1"]), ("T12/A7+A8", ["A7", "A8"]), ("/T1", ["T1"]),
    ("T13/A2+A5+A7+A8", ["A2", "A5", "A7", "A8"]), ("T1/T2/T3", ["T2", "T3"]), ("A1/ A2 - A2", ["A2", "A2"]),
    ("A1/x9", []), ("A1/AB", []), ("A1/Q9Z", []), ("A1/Q9Z8", ["Q9Z8"]), ("A1/1A2", []), ("A1/", []), ("A1/A2x", []),
]


def test_ratio_codes_of_known_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(RATIO_TEXTS)], "i int, r string")
    got = {r.i: r.c for r in df.select("i", D.ratio_codes("r").alias("c")).collect()}
    assert [got[i] for i in range(len(RATIO_TEXTS))] == [codes for _, codes in RATIO_TEXTS]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.one_of(st.integers(-10**6, 10**6).map(lambda i: i / 200.0),
                          st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False)),
                min_size=100, max_size=300))
def test_rounding_matches_duckdb(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r.i: (r.a, r.b) for r in df.select("i", D.round_half_away("v", 2).alias("a"),
                                                D.round_half_away("v", 1).alias("b")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    want = {i: (a, b) for i, a, b in con.execute(
        "SELECT i, ROUND(v * 100) / 100, ROUND(v * 10) / 10 FROM t").fetchall()}
    assert got == want


def test_two_level_equals_direct_distinct(spark, tables):
    o = tables.sales_orders.withColumn("d", F.col("order_id") % 3)
    flags = {"a": F.col("file_no").isNotNull(), "b": F.col("d") == 1, "c": F.lit(True)}
    two = two_level_aggregate(o, ["salesperson"], "order_id", flags,
                              {"s": F.col("gp1")}, {"m": F.col("gp2")})
    direct = o.groupBy("salesperson").agg(
        F.count_distinct(F.when(flags["a"], F.col("order_id"))).alias("a"),
        F.count_distinct(F.when(flags["b"], F.col("order_id"))).alias("b"),
        F.count_distinct("order_id").alias("c"),
        F.sum("gp1").alias("s"),
        (F.sum("gp2").cast("double") / F.count("gp2")).alias("m"))
    key = lambda r: (r.salesperson or "",)
    a = sorted(two.select("salesperson", "a", "b", "c", "s", "m").collect(), key=key)
    b = sorted(direct.collect(), key=key)
    assert [tuple(r) for r in a] == [tuple(r) for r in b]

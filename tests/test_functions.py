"""Row-wise functions on the literal edge-case frames of FIXTURES.md."""

import datetime as dt

from pyspark.sql import functions as F

from dealbook import functions as D


def _one(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_try_date_shapes(spark):
    texts = ["2024-01-15", "2024-01-15T10:00:00Z", "2024-01-15 10:00:00", "2024/1/5",
             "15/01/2024", "2024", "", None, "2024-02-30", "pending"]
    got = _one(spark, texts, D.try_date)
    assert got == [dt.date(2024, 1, 15), dt.date(2024, 1, 15), dt.date(2024, 1, 15), dt.date(2024, 1, 5),
                   None, None, None, None, None, None]


def test_ratio_codes(spark):
    got = _one(spark, ["T1/A1+B22-C", "A1", "x/", "a/A1 A1", None, "T12/A7+A8", "T13/A2+A5+A7+A8"], D.ratio_codes)
    assert got == [["A1", "B22"], [], [], ["A1", "A1"], [], ["A7", "A8"], ["A2", "A5", "A7", "A8"]]


def test_round_half_away(spark):
    got = _one(spark, [1.005, 2.675, 1.115, -2.5, 0.125, 1.0 / 3], lambda c: D.round_half_away(c, 2), "double")
    # Scaled rounding (what the engines compute on doubles): 1.005*100 = 100.49999...
    assert got == [1.0, 2.68, 1.12, -2.5, 0.13, 0.33]
    got0 = _one(spark, [-2.5, 2.5, 0.5], lambda c: D.round_half_away(c, 0), "double")
    assert got0 == [-3.0, 3.0, 1.0]


def test_safe_and_variance_pct(spark):
    df = spark.createDataFrame([(5.0, 0.0), (5.0, 10.0), (-5.0, -10.0)], "v double, d double")
    rows = df.select(D.safe_pct("v", "d").alias("p"), D.variance_pct("v", "d").alias("w")).collect()
    assert [r.p for r in rows] == [None, 50.0, 50.0]
    assert [r.w for r in rows] == [None, 50.0, -50.0]


def test_file_name_parts_and_substrings(spark):
    names = ["BalanceAlpha_MM011997_v1.xlsx", "BalanceBeta.XLS", "A_B_C_D.xls", "x.csv"]
    parts = _one(spark, names, D.file_name_parts)
    assert parts == [["BalanceAlpha", "MM011997", "v1"], ["BalanceBeta"], ["A", "B", "C_D"], ["x.csv"]]
    assert _one(spark, ["MM011997", "ab", ""], lambda c: D.text_right(c, 4)) == ["1997", "ab", ""]


def test_first_of_month(spark):
    df = spark.createDataFrame([(1997, 1), (1997, 13), (None, 5), (2024, 2)], "y int, m int")
    got = [r[0] for r in df.select(D.first_of_month(F.col("y"), F.col("m"))).collect()]
    assert got == [dt.date(1997, 1, 1), None, None, dt.date(2024, 2, 1)]


def test_month_text_and_label(spark):
    got = _one(spark, ["1", "01", " 12 ", "ACUMULADO", "total", "MESACUMULADO", "13", None], D.month_text)
    assert got == ["Enero", "Enero", "Diciembre", "Total", "Total", "MESACUMULADO", "13", None]
    assert _one(spark, ["1", "12", "Total"], D.month_label) == ["Enero", "Diciembre", "Total"]


def test_keys_and_labels(spark):
    df = spark.createDataFrame([("6001", 3, 1), ("6002", None, 2)], "a string, c int, s int")
    assert [r[0] for r in df.select(D.composite_key("a", "c", "s")).collect()] == ["6001-3-1", "6002--2"]
    df = spark.createDataFrame([("B1", "name"), (None, "name"), ("B1", None), (None, None)], "i string, n string")
    assert [r[0] for r in df.select(D.label_concat("i", "n")).collect()] == ["B1 name", "name", "B1", ""]


def test_accounting_and_percent(spark):
    got = _one(spark, [1234567.4, -1234.5, 0.4, -0.4, 2.5, None], D.accounting, "double")
    assert got == ["1.234.567", "(1.234)", "0", "0", "2", ""]
    got = _one(spark, [12.345678, None, float("nan"), -3.0], D.percent_text, "double")
    assert got == ["12.35 %", "", "", "-3.00 %"]
    assert _one(spark, [1.0, -2.0, 0.0, None], D.sign_class, "double") == ["pos", "neg", "zero", None]


def test_try_number(spark):
    assert _one(spark, ["12.5", " 7 ", "n/a", None, ""], lambda c: D.try_number(c, "double")) == [12.5, 7.0, None, None, None]
    assert _one(spark, ["5", "x", None], D.to_int) == [5, None, None]

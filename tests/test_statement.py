"""Statement reports: budget months, unknown company, month ties, prior year."""

import pytest
from pyspark.sql import functions as F

from dealbook.plans import etl, statement

TEMPLATE = [(1, "x", "A1", "T1", "A1/A2"), (2, "y", "A2", "T1", None), (3, "t", "T1", None, "T1/A1")]
TSCHEMA = "n int, concept string, category string, parent string, ratio string"


def test_budget_months_1_and_01_are_one_month(spark):
    budget = spark.createDataFrame([("A1", 1, "2024", "1", 10.0), ("A1", 1, "2024", "01", 5.0)],
                                   "category string, company_code int, year string, month string, base_total double")
    dim = spark.createDataFrame([(1, "ACME")], "code int, company string")
    leaf = statement.budget_leaf(budget, dim, "ACME", 2024).collect()
    assert [(r.category, r.month, r.value) for r in leaf] == [("A1", 1, 15.0)]
    assert statement.budget_leaf(budget, dim, "NOBODY", 2024).count() == 0


def test_percentages_and_zero_denominator(spark):
    t = spark.createDataFrame(TEMPLATE, TSCHEMA)
    ledger = spark.createDataFrame([("C", 2024, 1, "A1", 30.0), ("C", 2024, 1, "A2", 0.0), ("C", 2024, 2, "A2", 10.0)],
                                   "company string, year int, month int, category string, monthly_balance double")
    rows = {(r.category, r.period): r for r in statement.pnl_long(spark, ledger, t, "C", 2024).collect()}
    assert rows[("A1", "1")].pct is None            # A2 is 0 in month 1
    assert rows[("A1", "Total")].pct == 300.0
    assert rows[("T1", "1")].value == 30.0 and rows[("T1", "1")].pct == 100.0
    assert rows[("A1", "2")].value == 0.0            # missing -> 0
    assert statement.pnl_long(spark, ledger, t, "C", 1999).count() == 0   # empty leaf -> empty report


def test_best_and_worst_month_ties_go_to_later_month(spark):
    long = spark.createDataFrame(
        [(1, "T18", "pl", True, "1", 5.0, None), (1, "T18", "pl", True, "2", 5.0, None),
         (1, "T18", "pl", True, "3", -1.0, None), (1, "T18", "pl", True, "4", -1.0, None),
         (1, "T18", "pl", True, "Total", 8.0, None)],
        "n int, category string, concept string, is_total boolean, period string, value double, pct double")
    k = statement.pnl_kpis(long).collect()[0]
    assert (k.best_month, k.best_value, k.worst_month, k.worst_value) == (2, 5.0, 4, -1.0)
    assert k.pnl_total == 8.0 and k.net_total == 0.0


def test_prior_year_requires_a_year(spark, tables):
    with pytest.raises(ValueError):
        statement.pnl_vs_prior_year(spark, tables.ledger, tables.statement_template, "EUROPE", "Todos", 5)


def test_vs_budget_total_is_difference(spark, tables):
    budget = etl.transform_budget(tables.budget_raw)
    out = statement.pnl_vs_budget(spark, tables.ledger, budget, tables.dim_company, tables.statement_template,
                                  "EUROPE", 1997)
    for r in out.where(F.col("period") == "Total").collect():
        assert abs(r.diff - (r.real - r.budget)) < 1e-6


def test_waterfall_steps_add_up(spark, tables):
    long = statement.pnl_long(spark, tables.ledger, tables.statement_template, "EUROPE", 1997)
    steps = {r.step: r.value for r in statement.pnl_waterfall(long).collect()}
    assert len(steps) == 8
    assert abs(steps[4] + steps[5] - steps[6]) < 1e-6 and abs(steps[6] + steps[7] - steps[8]) < 1e-6


LEDGER_SCHEMA = ("company string, year int, month int, category string, account string, account_name string, "
                 "centre_name string, centre int, section int, monthly_balance double")


def test_vs_budget_with_empty_budget_side(spark):
    t = spark.createDataFrame(TEMPLATE, TSCHEMA)
    ledger = spark.createDataFrame([("C", 2024, 1, "A1", 30.0), ("C", 2024, 2, "A2", 10.0)],
                                   "company string, year int, month int, category string, monthly_balance double")
    budget = spark.createDataFrame([], "category string, company_code int, year string, month string, base_total double")
    dim = spark.createDataFrame([(1, "C")], "code int, company string")
    rows = {(r.category, r.period): r for r in statement.pnl_vs_budget(spark, ledger, budget, dim, t, "C", 2024).collect()}
    assert rows[("A1", "1")].real == 30.0 and rows[("A1", "1")].budget == 0.0 and rows[("A1", "1")].var_pct is None
    assert rows[("T1", "Total")].real == 40.0 and rows[("T1", "Total")].diff == 40.0
    assert {p for _, p in rows} == {"1", "2", "Total"}


def test_drilldown_keeps_null_keys_and_null_sums_are_zero(spark):
    from dealbook.plans.drilldown import account_drilldown

    ledger = spark.createDataFrame(
        [("C", 2024, 1, "A7", "6001", "acc", None, None, 1, 5.0),
         ("C", 2024, 2, "A7", "6001", "acc", None, None, 1, -8.0),
         ("C", 2024, 1, "A7", "6002", "acc2", "x", 3, 2, None)], LEDGER_SCHEMA)
    rows = {r.account: r for r in account_drilldown(ledger, "C", 2024, "A7").collect()}
    assert rows["6001"].centre is None and rows["6001"].total == -3.0 and rows["6001"].balance_2 == -8.0
    assert rows["6002"].total == 0.0 and rows["6002"].balance_1 == 0.0
    assert [r.account for r in account_drilldown(ledger, "C", 2024, "A7").collect()] == ["6001", "6002"]


def test_budget_etl_keeps_null_category_and_month(spark):
    raw = spark.createDataFrame([(None, 1, "2024", "3", 1.0), ("A1", 1, "2024", None, 2.0), ("T2", 1, "2024", "3", 4.0),
                                 ("A1", 1, "2024", "MESACUMULADO", 8.0), ("A1", 1, "2024", " acumulado ", 16.0)],
                                "category string, company_code int, year string, month string, base_total double")
    out = sorted((r.base_total, r.month_text) for r in etl.transform_budget(raw).collect())
    assert out == [(1.0, "Marzo"), (2.0, None)]


def test_by_period_maps_equal_the_wide_columns_without_a_job(spark, tables):
    from dealbook.plans import statement

    tracker = spark.sparkContext.statusTracker()
    assert tables.ledger.columns and tables.statement_template.columns   # the schemas are read
    spark.sparkContext.setJobGroup("by-period-plan", "planning")
    long = statement.pnl_long(spark, tables.ledger, tables.statement_template, "EUROPE", 1997)
    planned = len(tracker.getJobIdsForGroup("by-period-plan"))
    maps = statement.by_period(long, ["value", "pct"])
    assert len(tracker.getJobIdsForGroup("by-period-plan")) == planned <= 1   # the template's lines at most
    wide = {r.n: r for r in statement.pnl_wide(spark, tables.ledger, tables.statement_template, "EUROPE", 1997).collect()}
    for r in maps.collect():
        assert {p: v for p, v in r.value.items()} == {
            p: wide[r.n][f"res_{p}"] for p in [*map(str, range(1, 13)), "Total"] if wide[r.n][f"res_{p}"] is not None}


def test_wide_reports_read_the_ledger_once(spark, tables):
    from pyspark.sql import functions as F

    from dealbook.plans import drilldown, statement

    seen = spark.sparkContext.accumulator(0)
    rows = [("EUROPE", 1997, m, "A1", "6001", "n", "c", 1, 1, 10.0) for m in (1, 2, 13)]
    ledger = spark.createDataFrame(rows, "company string, year int, month int, category string, account string, "
                                         "account_name string, centre_name string, centre int, section int, monthly_balance double")

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    ledger = ledger.withColumn("monthly_balance", counted("monthly_balance"))
    wide = statement.pnl_wide(spark, ledger, tables.statement_template, "EUROPE", 1997)
    assert "res_13" in wide.columns and wide.where("category = 'A1'").first().res_Total == 30.0
    assert seen.value == 3
    out = drilldown.account_drilldown(ledger, "EUROPE", 1997, "A1").collect()
    assert out[0].total == 30.0 and out[0].balance_13 == 10.0 and seen.value == 6

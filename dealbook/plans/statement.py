"""P&L statement engine.

Everything stays in long form ``(keys, category, period, value)`` until the
report edge. The only large input is the fact table. It is filtered (pushed
to the Parquet scan) and combined to ``(category, month)`` map-side before
its one shuffle, and it is read once per report.

From there, each leaf row is mapped through the template bridge
(``operators.hierarchy``) to the codes it adds to, and everything is summed
in one grouping-sets aggregation. Month-presence markers ride in the same
aggregation. One broadcast join then hands every template line its value,
its denominator codes and its months.

The template and everything derived from it are a few hundred rows at most;
they are broadcast behind a row-count proof.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DecimalType

from dealbook.functions import ratio_codes, safe_pct, starts_with_total, variance_pct
from dealbook.operators.filters import all_of, equals_unless_unset, unset
from dealbook.operators.hierarchy import template_bridge
from dealbook.sources.sinks import statement_export, stored

TOTAL_PERIOD = "Total"
MONTHS = list(range(1, 13))
PERIODS = [str(m) for m in MONTHS] + [TOTAL_PERIOD]


# --- leaf values --------------------------------------------------------------

def ledger_leaf(ledger: DataFrame, company=None, year=None) -> DataFrame:
    """Ledger summed by ``(category, month)`` under optional company/year filters."""
    conds = equals_unless_unset("company", company) + (
        [] if unset(year) else [F.col("year") == F.lit(int(year))])
    return (ledger.where(all_of(conds))
            .groupBy("category", "month")
            .agg(F.sum("monthly_balance").alias("value")))


def company_code(dim_company: DataFrame, company) -> Column:
    """Company name -> code as a scalar subquery (J3); NULL when unknown."""
    return (dim_company.where(F.col("company") == F.lit(company))
            .agg(F.min("code").alias("code")).scalar())


def budget_leaf(budget: DataFrame, dim_company: DataFrame, company=None, year=None) -> DataFrame:
    """Budget summed by ``(category, int month)`` (A9). Months '1' and '01' are
    one month. An unknown company matches nothing."""
    conds = []
    if not unset(company):
        conds.append(F.col("company_code") == company_code(dim_company, company))
    if not unset(year):
        conds.append(F.col("year") == F.lit(str(year)))
    return (budget.where(all_of(conds))
            .withColumn("month", F.col("month").try_cast("int"))
            .groupBy("category", "month")
            .agg(F.sum("base_total").alias("value")))


# --- values of every code -----------------------------------------------------

# Code under which every leaf row also records "this month has data". The
# statement's months are the months present in the leaf, including months
# whose only postings are outside the template; these marker rows carry
# that information through the same aggregation as the values.
MARKER = "\u0000months"


def statement_values(spark: SparkSession, leaf: DataFrame, template: DataFrame,
                     keys: tuple[str, ...] = ()) -> DataFrame:
    """``(*keys, category, period, value, _cnt)`` for leaf codes, total codes and markers.

    Total codes of the template get the closure sum of their leaves (their own
    postings are replaced); every other code keeps its postings. ``period`` is
    the month as text, plus 'Total' = sum over the months. ``keys`` are extra
    grouping columns of ``leaf`` (a side, a year) carried through. Rows with
    ``category = MARKER`` exist for every month with data and for 'Total'.

    Plan: the leaf (already combined per code and month) is joined to the
    broadcast code->targets map, exploded, multiplied by the number of paths,
    and summed once with grouping sets
    ``(keys, category, month)`` and ``(keys, category)``: one shuffle of the
    small leaf; the fact table is read once.
    """
    targets = F.broadcast(template_bridge(spark, template))
    raw = leaf.where(F.col("month").isNotNull())

    def once(code: Column) -> Column:
        return F.array(F.struct(code.alias("category"), F.lit(1).cast("decimal(18,0)").alias("count")))

    own = F.coalesce("targets", once(raw.category))
    kind = leaf.schema["value"].dataType
    # Exact money stays exact: a sum of 28 digits times a count of 18 would lose its cents to the precision rules.
    money = "decimal(38,2)" if isinstance(kind, DecimalType) else kind.simpleString()
    mapped = (raw.join(targets, raw.category == targets.code, "left")
              .select(*keys, F.explode(F.concat(own, once(F.lit(MARKER)))).alias("t"), "month", "value")
              .select(*keys, "t.category", "month", (F.col("value") * F.col("t.count")).cast(money).alias("value")))
    sets = [[*keys, "category", "month"], [*keys, "category"]]
    agg = mapped.groupingSets(sets, *keys, "category", "month").agg(
        F.sum("value").alias("value"), F.count(F.lit(1)).alias("_cnt"), F.grouping("month").alias("_g"))
    return agg.select(*keys, "category",
                      F.when(F.col("_g") == 1, F.lit(TOTAL_PERIOD))
                      .otherwise(F.col("month").cast("string")).alias("period"),
                      "value", "_cnt")


def template_rows(template: DataFrame) -> DataFrame:
    return template.select("n", "category", "concept", "ratio",
                           starts_with_total("category").alias("is_total"))


ROW_COLS = ["_row", "n", "category", "concept", "is_total"]


def requests(template: DataFrame, with_ratio: bool = True) -> DataFrame:
    """What each template line needs: its own value ('v'), its denominator
    codes ('d', duplicates kept) and the period marker ('p').

    ``(_row, n, category, concept, is_total, code, role)``: a few rows per
    template line, broadcast into the single join with the values (bounded by
    the template check).
    """
    rows = template_rows(template).withColumn("_row", F.monotonically_increasing_id())
    need = F.array(F.struct(F.col("category").alias("code"), F.lit("v").alias("role")),
                   F.struct(F.lit(MARKER).alias("code"), F.lit("p").alias("role")))
    if with_ratio:
        need = F.concat(need, F.transform(ratio_codes("ratio"), lambda c: F.struct(
            c.alias("code"), F.lit("d").alias("role"))))
    out = rows.select(*ROW_COLS, F.explode(need).alias("r"))
    return out.select(*ROW_COLS, "r.code", "r.role")


def _lookup(values: DataFrame, reqs: DataFrame) -> DataFrame:
    """Requests with the values they ask for, for every period of the data.

    An inner join with the broadcast requests as build side streams the values
    without shuffling them. Every line asks for the marker, and the marker has
    a row for each period with data, so each line comes out once per period.
    """
    return F.broadcast(reqs).join(values.withColumnRenamed("category", "code"), "code", "inner")


def _sum_role(role: str, extra: Column | None = None) -> Column:
    cond = F.col("role") == role
    if extra is not None:
        cond = cond & extra
    return F.sum(F.when(cond, F.col("value")))


def _present(extra: Column | None = None) -> Column:
    cond = F.col("role") == "p"
    if extra is not None:
        cond = cond & extra
    return F.coalesce(F.max(F.when(cond, F.col("_cnt"))), F.lit(0)) > 0


def statement_long(spark: SparkSession, leaf: DataFrame, template: DataFrame,
                   value_name: str = "value") -> DataFrame:
    """One row per template line and period with data: value (0 when missing)
    and the percentage over the parsed denominator codes (NULL when they sum
    to 0) (R7). Periods are the months found in the data, whatever their
    number, then 'Total'; an empty leaf gives an empty report."""
    joined = _lookup(statement_values(spark, leaf, template), requests(template))
    agg = joined.groupBy(*ROW_COLS, "period").agg(
        _sum_role("v").alias("value"), _sum_role("d").alias("denominator"))
    return agg.select(
        "n", "category", "concept", "is_total", "period",
        F.coalesce("value", F.lit(0)).cast("double").alias(value_name),
        safe_pct(F.coalesce("value", F.lit(0)), F.coalesce("denominator", F.lit(0))).alias("pct"),
    )


def data_periods(leaf: DataFrame) -> list[str]:
    """Months found in a leaf, ascending, then 'Total' (empty without data).

    The result is a list of month numbers. Column names come from data here,
    so reports with a column per period store their leaf first (``stored``):
    the fact table is read once, for the leaf.
    """
    months = leaf.select("month").where(F.col("month").isNotNull()).distinct().collect()
    return [str(m) for m in sorted(r["month"] for r in months)] + ([TOTAL_PERIOD] if months else [])


def wide_periods(leaf: DataFrame) -> list[str]:
    """Column periods of a wide report: months 1-12, any other month found, 'Total'."""
    extra = [p for p in data_periods(leaf) if p not in PERIODS]
    return PERIODS[:-1] + extra + [TOTAL_PERIOD]


def widen(long: DataFrame, measures: list[str], periods: list[str] = PERIODS,
          keys: tuple[str, ...] = ("n", "category", "concept", "is_total")) -> DataFrame:
    """Long -> wide: ``{measure}_{period}`` columns for a period list (report edge).

    A period absent from the data gives NULL columns.
    """
    aggs = [F.max(F.when(F.col("period") == F.lit(p), F.col(m))).alias(f"{m}_{p}")
            for p in periods for m in measures]
    return long.groupBy(*keys).agg(*aggs)


# --- reports ------------------------------------------------------------------

def pnl_long(spark, ledger, template, company=None, year=None) -> DataFrame:
    """Actual P&L, long form."""
    return statement_long(spark, ledger_leaf(ledger, company, year), template, value_name="value")


def pnl_wide(spark, ledger, template, company=None, year=None) -> DataFrame:
    """Actual P&L, ``res_{period}``/``pct_{period}`` columns, template order."""
    leaf = stored(ledger_leaf(ledger, company, year), "ledger-leaf")
    return widen(statement_long(spark, leaf, template, "res"), ["res", "pct"], wide_periods(leaf)).orderBy("n")


def pnl_export(spark, ledger, template, company=None, year=None) -> DataFrame:
    """Actual P&L in the flat layout of the export: months with data only, 'Total' last."""
    leaf = stored(ledger_leaf(ledger, company, year), "ledger-leaf")
    periods = data_periods(leaf)
    return statement_export(widen(statement_long(spark, leaf, template, "res"), ["res", "pct"], periods), periods)


def by_period(long: DataFrame, measures: list[str],
              keys: tuple[str, ...] = ("n", "category", "concept", "is_total")) -> DataFrame:
    """Long -> one row per line with a map (period to value) per measure.

    Every period of the data is a map key, so no column name comes from data
    and nothing runs before the query does. A line has one entry per period.
    """
    return long.groupBy(*keys).agg(*[
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("period", F.col(m))))).alias(m) for m in measures])


def budget_long(spark, budget, dim_company, template, company=None, year=None) -> DataFrame:
    """Budget statement, long form."""
    return statement_long(spark, budget_leaf(budget, dim_company, company, year), template,
                          value_name="budget")


def budget_wide(spark, budget, dim_company, template, company=None, year=None) -> DataFrame:
    leaf = stored(budget_leaf(budget, dim_company, company, year), "budget-leaf")
    return widen(statement_long(spark, leaf, template, "budget"), ["budget", "pct"], wide_periods(leaf)).orderBy("n")


def pnl_vs_budget(spark, ledger, budget, dim_company, template, company=None, year=None) -> DataFrame:
    """Actual vs budget per template line and period: real, budget, diff, var %.

    Both leaves go through one closure map and one aggregation, keyed by
    side. Periods are the months of either side plus 'Total'; each side's
    Total sums that side's months; a side missing a period counts 0.
    """
    leaf = (ledger_leaf(ledger, company, year).withColumn("side", F.lit("real"))
            .unionByName(budget_leaf(budget, dim_company, company, year).withColumn("side", F.lit("budget"))))
    values = statement_values(spark, leaf, template, keys=("side",))
    joined = _lookup(values, requests(template, with_ratio=False))
    agg = joined.groupBy(*ROW_COLS, "period").agg(
        _sum_role("v", F.col("side") == "real").alias("real"),
        _sum_role("v", F.col("side") == "budget").alias("budget"))
    out = (agg
           .withColumn("real", F.coalesce("real", F.lit(0)).cast("double"))
           .withColumn("budget", F.coalesce("budget", F.lit(0)).cast("double")))
    return out.select("n", "category", "concept", "is_total", "period", "real", "budget",
                      (F.col("real") - F.col("budget")).alias("diff"),
                      variance_pct(F.col("real") - F.col("budget"), "budget").alias("var_pct"))


def pnl_vs_prior_year(spark, ledger, template, company, year, month: int) -> DataFrame:
    """One month against the same month of the previous year.

    One scan reads both years (``year IN (y, y-1)``); the statement is built
    per year by carrying the year as a key. The report exists only when the
    current year has postings with a month. Year 'all' is an error.
    """
    if unset(year):
        raise ValueError("a specific year is required")
    y = int(year)
    conds = equals_unless_unset("company", company) + [F.col("year").isin(y, y - 1)]
    leaf = (ledger.where(all_of(conds)).groupBy("year", "category", "month")
            .agg(F.sum("monthly_balance").alias("value")))
    values = statement_values(spark, leaf, template, keys=("year",))
    # Only the asked month's values, and the marker that the year has data at all.
    values = values.where(F.when(F.col("category") == MARKER, F.col("period") == TOTAL_PERIOD)
                          .otherwise(F.col("period") == str(int(month))))
    joined = _lookup(values, requests(template, with_ratio=False))
    agg = joined.groupBy(*ROW_COLS).agg(
        _sum_role("v", F.col("year") == y).alias("current"),
        _sum_role("v", F.col("year") == y - 1).alias("prior"),
        _present(F.col("year") == y).alias("present"))
    out = (agg.where("present")
           .withColumn("current", F.coalesce("current", F.lit(0)).cast("double"))
           .withColumn("prior", F.coalesce("prior", F.lit(0)).cast("double")))
    return out.select("n", "category", "concept", "is_total", "current", "prior",
                      (F.col("current") - F.col("prior")).alias("diff"),
                      variance_pct(F.col("current") - F.col("prior"), "prior").alias("var_pct"))


def filter_options(ledger: DataFrame, dim_company: DataFrame, dim_time: DataFrame):
    """Companies of the company dimension, and dimension years that occur in
    the ledger (semi join) (R6). Display order: A-Z and newest first."""
    companies = dim_company.select("company").distinct().orderBy("company")
    # Distinct years first: a partial aggregate leaves a handful of rows per
    # task, so the semi join never shuffles the ledger itself (a year holds a
    # large share of all rows and would land in one partition).
    ledger_years = (ledger.select(F.col("year").try_cast("int").alias("y"))
                    .where(F.col("y").isNotNull()).distinct())
    years = (dim_time.join(ledger_years, F.col("year") == F.col("y"), "left_semi")
             .select(F.col("year").try_cast("int").alias("year")).where(F.col("year").isNotNull()).distinct()
             .orderBy(F.col("year").desc()))
    return companies, years


def month_list(ledger: DataFrame, company=None, year=None) -> DataFrame:
    """Months with postings under the filters, ascending (O7); NULL months dropped."""
    conds = equals_unless_unset("company", company) + ([] if unset(year) else [F.col("year") == F.lit(int(year))])
    return (ledger.where(all_of(conds)).select("month").where(F.col("month").isNotNull()).distinct()
            .orderBy("month"))


# --- dashboard derivations (R15-R17) -------------------------------------------

def _month(period: str = "period") -> Column:
    return F.when(F.col(period) != TOTAL_PERIOD, F.col(period).cast("int"))


def _line(code: str, measure: str = "value") -> Column:
    """Value of a total line within a group (NULL when the line is absent)."""
    return F.max(F.when(F.col("is_total") & (F.col("category") == code), F.col(measure)))


def pnl_kpis(long: DataFrame) -> DataFrame:
    """P&L total, net total, |general costs|, |staff costs|, best and worst month.

    One pass over the statement: per period the needed lines, then one global
    aggregate. A missing line counts 0. Ties between months go to the later
    month, as the dashboard's reduce does.
    """
    per = long.groupBy("period").agg(
        F.coalesce(_line("T18"), F.lit(0.0)).alias("t18"), _line("T13").alias("t13"),
        _line("T14").alias("t14"), _line("T15").alias("t15"))
    total = F.col("period") == TOTAL_PERIOD
    month = _month()

    def at_total(c: str) -> Column:
        return F.coalesce(F.max(F.when(total, F.col(c))), F.lit(0.0))

    best_key = F.when(month.isNotNull(), F.struct(F.col("t18"), month))
    worst_key = F.when(month.isNotNull(), F.struct(F.col("t18"), -month))
    return per.agg(
        at_total("t18").alias("pnl_total"), at_total("t13").alias("net_total"),
        F.abs(at_total("t14")).alias("general_costs"), F.abs(at_total("t15")).alias("staff_costs"),
        F.max_by(month, best_key).alias("best_month"), F.max_by("t18", best_key).alias("best_value"),
        F.min_by(month, worst_key).alias("worst_month"), F.min_by("t18", worst_key).alias("worst_value"))


def pnl_best_worst_month(long: DataFrame) -> DataFrame:
    """Best and worst month of the P&L line (A19): the month columns of R15."""
    return pnl_kpis(long).select("best_month", "best_value", "worst_month", "worst_value")


# Codes plotted per month and their output names.
SERIES_VALUES = [("T18", "pnl"), ("T13", "net_total"), ("T2", "net_new"), ("T4", "net_used"),
                 ("T12", "net_after_sales")]
SERIES_PCTS = [("T1", "gross_new_pct"), ("T2", "net_new_pct"), ("T13", "net_total_pct"), ("T18", "pnl_pct")]


def pnl_series(long: DataFrame) -> DataFrame:
    """Per month: values of T18, T13, T2, T4, T12 (0 when missing) and the
    percentages of T1, T2, T13, T18 (NULL when missing) (R16). One pass."""
    aggs = [F.coalesce(_line(c), F.lit(0.0)).alias(name) for c, name in SERIES_VALUES]
    aggs += [_line(c, "pct").alias(name) for c, name in SERIES_PCTS]
    return (long.where(F.col("period") != TOTAL_PERIOD)
            .groupBy(F.col("period").cast("int").alias("month")).agg(*aggs))


# Waterfall steps: (order, label, code added, code subtracted).
WATERFALL = [(1, "Net total", "T13", None), (2, "General costs", "T14", None),
             (3, "Staff costs", "T15", None), (4, "Result I+A", "T16", None),
             (5, "Interest+Amort.", "T17", "T16"), (6, "Operating result", "T17", None),
             (7, "Other", "T18", "T17"), (8, "P&L", "T18", None)]


def pnl_waterfall(long: DataFrame) -> DataFrame:
    """Eight waterfall steps from the Total column of the total lines."""
    tot = long.where(F.col("is_total") & (F.col("period") == TOTAL_PERIOD))

    def v(code: str | None) -> Column:
        if code is None:
            return F.lit(0.0)
        return F.coalesce(F.max(F.when(F.col("category") == code, F.col("value"))), F.lit(0.0))

    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(label).alias("name"),
                               (v(add) - v(sub)).alias("value"))
                      for i, label, add, sub in WATERFALL])
    return tot.agg(steps.alias("s")).select(F.inline("s"))

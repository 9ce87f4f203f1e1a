"""Account drill-down of one statement category."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dealbook.operators.filters import all_of, equals_unless_unset, unset
from dealbook.sources.sinks import stored

ACCOUNT_KEYS = ["account", "account_name", "centre_name", "centre", "section"]


def account_drilldown(ledger: DataFrame, company, year, category: str,
                      months: list[int] | None = None) -> DataFrame:
    """One row per account/centre/section: ``balance_{m}`` per month (0 when
    missing) and ``total``; largest absolute total first. Months are 1-12 and
    any other month found, so the columns always add up to ``total``.

    The postings are summed per account and month once and stored; the month
    list and the columns come from those rows, so the ledger is read once.
    With ``months`` given nothing is stored. Groups with a NULL key part are
    kept (NULL-safe grouping).
    """
    conds = equals_unless_unset("company", company) + [F.col("category") == F.lit(category)]
    if not unset(year):
        conds.append(F.col("year") == F.lit(int(year)))
    rows = ledger.where(all_of(conds)).groupBy(*ACCOUNT_KEYS, "month").agg(F.sum("monthly_balance").alias("balance"))
    if months is None:
        rows = stored(rows, "account-leaf")
        found = {r["month"] for r in rows.select("month").distinct().collect()} - {None}
        months = sorted(found | set(range(1, 13)))
    bal = F.col("balance")
    aggs = [F.coalesce(F.sum(F.when(F.col("month") == m, bal)), F.lit(0)).cast("double").alias(f"balance_{m}")
            for m in months]
    total = F.coalesce(F.sum(F.when(F.col("month").isNotNull(), bal)), F.lit(0)).cast("double").alias("total")
    out = rows.groupBy(*ACCOUNT_KEYS).agg(total, *aggs)
    return out.orderBy(F.abs("total").desc(), *ACCOUNT_KEYS)

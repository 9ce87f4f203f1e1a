"""Orders stored by notice month, so that a report on a period reads its months only.

The dates of the source are texts; ``year(parse(text)) = y`` can prune nothing.
Here they are parsed once, when the orders are stored. The table is partitioned
by notice month (NULL dates in a partition of their own), and an index table
tells in which notice months the orders of an order month lie. A report that
counts by both dates joins the table with the index rows of its period, and
Spark prunes the partitions by that join when the query runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dealbook.functions import try_date
from dealbook.operators.filters import all_of, unset

#: Partition of orders without a notice date.
NO_MONTH = 0


def month_number(date: Column) -> Column:
    """Year and month as one number (199705); NO_MONTH for NULL."""
    return F.coalesce(F.year(date) * 100 + F.month(date), F.lit(NO_MONTH))


def in_period(month: str, year=None, month_of_year=None) -> Column:
    conds = []
    if not unset(year):
        conds.append(F.floor(F.col(month) / 100) == int(year))
    if not unset(month_of_year):
        conds.append(F.col(month) % 100 == int(month_of_year))
    return all_of(conds)


@dataclass
class PeriodOrders:
    """Orders by notice month and the index of order months, in one folder."""

    spark: SparkSession
    path: str

    def index(self) -> DataFrame:
        """(order_month, notice_month) pairs that occur."""
        return self.spark.read.schema("order_month int, notice_month int").parquet(f"{self.path}/index")

    def orders(self, year=None, month=None, by_order: bool = True) -> DataFrame:
        """Orders with a notice date in the period and, with ``by_order``, those with an order date in it.

        Orders of other dates may come too, if they lie in a partition that is
        read; the reports filter by date as ever.
        """
        table = self.spark.read.option("basePath", f"{self.path}/orders").parquet(f"{self.path}/orders")
        if unset(year) and unset(month):
            return table
        wanted = in_period("notice_month", year, month)
        if by_order:
            wanted = wanted | in_period("order_month", year, month)
        months = self.index().where(wanted).select("notice_month").distinct()
        return table.join(months, "notice_month", "left_semi")


def store_by_period(orders: DataFrame, path: str) -> PeriodOrders:
    """Parses the dates once and writes the orders by notice month, and the index beside them.

    A month's rows come together, a large month is split: files follow the
    data, not the tasks.
    """
    typed = orders.withColumns({"order_date": try_date("order_date_txt"), "notice_date": try_date("notice_date_txt")})
    typed = typed.withColumns({"notice_month": month_number(F.col("notice_date")),
                               "order_month": month_number(F.col("order_date"))})
    typed.hint("rebalance", "notice_month").write.partitionBy("notice_month").parquet(f"{path}/orders")
    spark = orders.sparkSession
    (spark.read.parquet(f"{path}/orders").select("order_month", F.col("notice_month").cast("int"))
     .distinct().coalesce(1).write.parquet(f"{path}/index"))
    return PeriodOrders(spark, path)

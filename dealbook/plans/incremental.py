"""Salesperson summary kept up to date by batches.

What the summary needs of the orders is a state that merges: per salesperson,
order, VIN and the months of both dates, flags that combine by maximum and sums
and counts that add up. A batch of orders is reduced to such rows and stored
beside the others; the summary merges them. A batch that is added again
replaces itself, and the order of batches does not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dealbook.operators.distinct import two_level_aggregate
from dealbook.operators.filters import active_orders, unset
from dealbook.operators.joins import left_join_spread
from dealbook.plans.periods import NO_MONTH, in_period, month_number
from dealbook.plans.sales import notice_date, order_date, registered_vins, summary_report

KEYS = ["salesperson", "order_id", "vin", "order_month", "notice_month"]
FLAGS = ["uploaded", "pending", "financed"]
MEASURES = ["gp1", "gp2", "gp3", "discount_pct"]


def batch_state(orders: DataFrame) -> DataFrame:
    """The state rows of a batch of orders; active ones only."""
    rows = active_orders(orders).select(
        "salesperson", "order_id", "vin", month_number(order_date(orders)).alias("order_month"),
        month_number(notice_date(orders)).alias("notice_month"),
        F.col("file_no").isNotNull().alias("uploaded"), F.col("file_no").isNull().alias("pending"),
        F.coalesce(F.col("financed_amount") > 0, F.lit(False)).alias("financed"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("gp1", "gp2", "gp3")],
        (F.coalesce("discount", F.lit(0.0)).cast("decimal(20,10)") * F.lit(100)).alias("discount_pct"))
    return rows.groupBy(*KEYS).agg(
        *[F.max(c).alias(c) for c in FLAGS], F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in MEASURES])


class SummaryState:
    """State rows in a folder, one sub-folder per batch; a compaction is a batch that stands for others."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, batch: str, orders: DataFrame) -> None:
        """Adds a batch of orders, or replaces it if it has been added before; reads its rows only."""
        batch_state(orders).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def rows(self) -> DataFrame:
        """The merged state. A batch's sums are exact decimals, so merging in any order gives the same."""
        state = self.spark.read.option("basePath", self.path).parquet(f"{self.path}/batch=*")
        return state.groupBy(*KEYS).agg(*[F.max(c).alias(c) for c in FLAGS], F.sum("rows").alias("rows"),
                                        *[F.sum(c).alias(c) for c in MEASURES])

    def summary(self, stock: DataFrame, year=None, month=None, ordered: bool = True) -> DataFrame:
        """The salesperson summary of all batches (R1), plates as of the stock given."""
        state = left_join_spread(self.rows(), registered_vins(stock), "vin", ["order_id", "salesperson"])
        in_notice = in_period("notice_month", year, month)
        in_order = (F.col("order_month") != NO_MONTH) & in_period("order_month", year, month)
        if not (unset(year) and unset(month)):
            state = state.where(in_notice | in_order)
        flags = {"plated": F.coalesce("registered", F.lit(False)) & in_notice, "orders": in_order, "sales": in_notice}
        flags |= {c: F.col(c) & in_notice for c in FLAGS}
        sums = {f"sum_gp{i}": F.when(in_notice, F.col(f"gp{i}")).otherwise(F.lit(0)) for i in (1, 2, 3)}
        sums |= {"sum_discount": F.when(in_notice, F.col("discount_pct")), "sum_rows": F.when(in_notice, F.col("rows"))}
        agg = two_level_aggregate(state, ["salesperson"], "order_id", flags, sums)
        means = {f"avg_gp{i}": f"sum_gp{i}" for i in (1, 2, 3)} | {"avg_discount_pct": "sum_discount"}
        agg = agg.withColumns({mean: F.try_divide(F.col(total).cast("double"), F.col("sum_rows").cast("double"))
                               for mean, total in means.items()})
        return summary_report(agg, ordered)

"""Sales reports: salesperson summary, totals, type shares and pivot, KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dealbook.functions import round_half_away, share_pct, try_date
from dealbook.operators.distinct import two_level_aggregate
from dealbook.operators.filters import active_orders, period, unset
from dealbook.operators.joins import (
    BUCKET_ROWS, PIECE_ROWS, SPREAD_KEY, dealt_by_key, frequent_keys, keyed, left_join_spread, repeated_by_key,
    write_bucketed,
)
from dealbook.operators.pivot import distinct_values, pivot_sum
from dealbook.operators.topk import top_k
from dealbook.operators.totals import append_total_row

# Fixed labels of the reference (sentinels for missing values and totals).
NO_SALESPERSON = "Sin asignar"
NO_SALE_TYPE = "Sin tipo"
TOTALS_LABEL = "TOTALES"
TOTAL_COLUMN = "TOTAL"

SUMMARY_COLUMNS = [
    "salesperson", "plated", "uploaded", "pending", "orders", "sales",
    "sum_gp1", "avg_gp1", "sum_gp2", "avg_gp2", "sum_gp3", "avg_gp3",
    "avg_discount_pct", "financed",
]
COUNT_COLUMNS = ["plated", "uploaded", "pending", "orders", "sales", "financed"]
SUM_COLUMNS = ["sum_gp1", "sum_gp2", "sum_gp3"]
MEAN_COLUMNS = ["avg_gp1", "avg_gp2", "avg_gp3", "avg_discount_pct"]


def registered_vins(stock: DataFrame) -> DataFrame:
    """VINs whose latest stock row has a registration date (W1 + J1), by their join key.

    The latest row by ``registration_date DESC`` has a date exactly when any
    row of the VIN has one, so a distinct VIN list is enough; it combines
    map-side, so a VIN repeated in a third of the stock rows costs one row
    per task.
    """
    return (keyed(stock.where(F.col("registration_date").isNotNull()), "vin")
            .select(SPREAD_KEY).distinct().withColumn("registered", F.lit(True)))


#: Column by which ``bucketed_sales_tables`` stores orders and stock.
VIN_BUCKET = "vin_bucket"


def bucketed_sales_tables(orders: DataFrame, stock: DataFrame, path: str, buckets: int, name: str = "sales",
                          bucket_rows: int = BUCKET_ROWS, piece_rows: int = PIECE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Orders and stock stored by VIN in as many sorted buckets each, so that reports join them without a shuffle.

    There are ``buckets`` of them, or one for each ``bucket_rows`` orders if
    that is more. Orders without a VIN are dealt over all buckets by their
    order id; those of a VIN with more than ``piece_rows`` orders over its
    pieces, each of which has the VIN's stock row. Stock is stored with the
    latest row of each VIN (W1).
    """
    rows, frequent = frequent_keys(orders, "vin", piece_rows)
    buckets = max(buckets, -(-rows // bucket_rows))
    # Stock rows without a VIN match no order.
    latest = (stock.where(F.col("vin").isNotNull()).groupBy("vin")
              .agg(F.max("registration_date").alias("registration_date")))
    return (write_bucketed(dealt_by_key(orders, "vin", ["order_id"], frequent), f"{name}_orders_by_vin", VIN_BUCKET,
                           buckets, f"{path}/orders"),
            write_bucketed(repeated_by_key(latest, "vin", frequent), f"{name}_stock_by_vin", VIN_BUCKET,
                           buckets, f"{path}/stock"))


def order_date(orders: DataFrame) -> Column:
    """Order date: the typed column of stored orders, else the parsed text."""
    return F.col("order_date") if "order_date" in orders.columns else try_date("order_date_txt")


def notice_date(orders: DataFrame) -> Column:
    """Notice date: the typed column of stored orders, else the parsed text."""
    return F.col("notice_date") if "notice_date" in orders.columns else try_date("notice_date_txt")


def order_base(orders: DataFrame, stock: DataFrame) -> DataFrame:
    """Active orders with parsed dates, zero-filled measures and the plate flag.

    Tables of ``bucketed_sales_tables`` are joined bucket by bucket, others by
    the spread VIN; either way the orders are read once.
    """
    bucketed = VIN_BUCKET in orders.columns and VIN_BUCKET in stock.columns
    base = active_orders(orders).select(
        "order_id", "salesperson", "vin", "file_no", "sale_type", "financed_amount",
        *[VIN_BUCKET] * bucketed,
        order_date(orders).alias("order_date"),
        notice_date(orders).alias("notice_date"),
        F.coalesce("gp1", F.lit(0)).alias("gp1"),
        F.coalesce("gp2", F.lit(0)).alias("gp2"),
        F.coalesce("gp3", F.lit(0)).alias("gp3"),
        # Exact decimal arithmetic keeps the mean independent of summation order.
        (F.coalesce("discount", F.lit(0.0)).cast("decimal(20,10)") * F.lit(100)).alias("discount_pct"),
    )
    # ``registered`` is NULL for orders without a registered VIN.
    if bucketed:
        plated = (stock.where(F.col("registration_date").isNotNull()).groupBy(VIN_BUCKET)
                  .agg(F.lit(True).alias("registered")))
        return base.join(plated, VIN_BUCKET, "left").drop(VIN_BUCKET)
    return left_join_spread(base, registered_vins(stock), "vin", ["order_id"])


def salesperson_summary(orders: DataFrame, stock: DataFrame, year=None, month=None,
                        ordered: bool = True) -> DataFrame:
    """Per-salesperson KPIs (R1). Orders are counted by order date, everything
    else by notice date; ``year``/``month`` None means no filter. ``ordered``
    sorts for display (most orders first); reports built on top pass False."""
    base = order_base(orders, stock)
    in_notice = period("notice_date", year, month)
    in_order = F.col("order_date").isNotNull() & period("order_date", year, month)
    if not (unset(year) and unset(month)):
        # A row outside both periods adds nothing to any measure, and a
        # salesperson with only such rows fails the HAVING clause; dropping
        # those rows before the shuffle is exact.
        base = base.where(in_notice | in_order)
    flags = {
        "plated": F.coalesce("registered", F.lit(False)) & in_notice,
        "uploaded": F.col("file_no").isNotNull() & in_notice,
        "pending": F.col("file_no").isNull() & in_notice,
        "orders": in_order,
        "sales": in_notice,
        "financed": (F.col("financed_amount") > 0) & in_notice,
    }
    sums = {f"sum_gp{i}": F.when(in_notice, F.col(f"gp{i}")).otherwise(F.lit(0)) for i in (1, 2, 3)}
    means = {f"avg_gp{i}": F.when(in_notice, F.col(f"gp{i}")) for i in (1, 2, 3)}
    means["avg_discount_pct"] = F.when(in_notice, F.col("discount_pct"))
    return summary_report(two_level_aggregate(base, ["salesperson"], "order_id", flags, sums, means), ordered)


def summary_report(agg: DataFrame, ordered: bool = True) -> DataFrame:
    """Rounded report rows of per-salesperson aggregates; a salesperson without orders and sales is left out."""
    agg = agg.where((F.col("orders") > 0) | (F.col("sales") > 0))
    if ordered:
        # Report order (O1): most orders first, name as tie-break; one small sort.
        agg = agg.orderBy(F.col("orders").desc(), F.col("salesperson").asc_nulls_last())
    return agg.select(
        F.coalesce("salesperson", F.lit(NO_SALESPERSON)).alias("salesperson"),
        *COUNT_COLUMNS[:5],
        *[round_half_away(c, 2).alias(c) for c in ["sum_gp1", "avg_gp1", "sum_gp2", "avg_gp2",
                                                 "sum_gp3", "avg_gp3", "avg_discount_pct"]],
        "financed",
    )


def summary_with_totals(orders: DataFrame, stock: DataFrame, year=None, month=None) -> DataFrame:
    """R1 plus the TOTALES row: counts and sums summed, means averaged over the
    salesperson rows (unweighted mean of means, NULLs skipped) (R2)."""
    summary = salesperson_summary(orders, stock, year, month, ordered=False)
    aggs = {c: F.sum(c) for c in COUNT_COLUMNS}
    aggs.update({c: round_half_away(F.sum(c), 2) for c in SUM_COLUMNS})
    aggs.update({c: round_half_away(F.avg(c), 2) for c in MEAN_COLUMNS})
    out = append_total_row(summary, "salesperson", TOTALS_LABEL, aggs)
    return out.orderBy("is_total", F.col("orders").desc(), F.col("salesperson").asc_nulls_last())


def sales_kpis(orders: DataFrame, stock: DataFrame, year=None, month=None) -> DataFrame:
    """Headline counts: plated, uploaded, pending, orders, sales."""
    summary = salesperson_summary(orders, stock, year, month, ordered=False)
    return summary.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
                         for c in ["plated", "uploaded", "pending", "orders", "sales"]])


def top_salespeople(orders: DataFrame, stock: DataFrame, measure: str, k: int = 10,
                    year=None, month=None) -> DataFrame:
    """Top-k salespeople by one summary column, totals row excluded.

    A NULL measure ranks as 0, as in the dashboard's numeric sort; ties are
    broken by name so the list is deterministic.
    """
    summary = salesperson_summary(orders, stock, year, month, ordered=False)
    return top_k(summary, F.coalesce(F.col(measure).cast("double"), F.lit(0.0)), k,
                 [F.col("salesperson").asc_nulls_last(), F.col("orders").desc()])


def sales_by_type(orders: DataFrame, year=None, month=None, ordered: bool = True) -> DataFrame:
    """Distinct orders per salesperson and sale type, with the share within the
    salesperson in percent, one decimal (R3). ``ordered`` sorts for display."""
    active = active_orders(orders)
    if not (unset(year) and unset(month)):
        active = active.where(period(notice_date(orders), year, month))
    # Distinct (salesperson, type, id) first: the shuffle is keyed by the id
    # too, so a hot salesperson/type pair is spread over many tasks.
    counts = (active.where(F.col("order_id").isNotNull())
              .select("salesperson", "sale_type", "order_id").distinct()
              .groupBy("salesperson", "sale_type").agg(F.count(F.lit(1)).alias("quantity")))
    per_person = Window.partitionBy("salesperson")
    out = counts.where(F.col("quantity") > 0).select(
        F.coalesce("salesperson", F.lit(NO_SALESPERSON)).alias("salesperson"),
        F.coalesce("sale_type", F.lit(NO_SALE_TYPE)).alias("sale_type"),
        F.col("quantity").cast("long").alias("quantity"),
        round_half_away(share_pct("quantity", F.sum("quantity").over(per_person)), 1).alias("share_pct"),
    )
    # Report order (O2): by salesperson, largest count first.
    return out.orderBy("salesperson", F.col("quantity").desc(), "sale_type") if ordered else out


def type_pivot(orders: DataFrame, year=None, month=None, types: list[str] | None = None) -> DataFrame:
    """Salesperson x sale type counts, a TOTAL column and a TOTALES row.

    ``types`` are the pivot columns; by default the sorted distinct types
    present (a bounded list, since they become columns).
    """
    shares = sales_by_type(orders, year, month, ordered=False)
    if types is None:
        # Headers from a pruned scan of the active orders, not from the report.
        active = active_orders(orders)
        if not (unset(year) and unset(month)):
            active = active.where(period(notice_date(orders), year, month))
        types = distinct_values(active.where(F.col("order_id").isNotNull())
                                .select(F.coalesce("sale_type", F.lit(NO_SALE_TYPE)).alias("sale_type")), "sale_type")
    reserved = {"salesperson", "is_total", TOTAL_COLUMN}
    if reserved & {str(t) for t in types}:
        raise ValueError(f"sale types cannot be named {sorted(reserved & {str(t) for t in types})}: they are report columns")
    wide = pivot_sum(shares, "salesperson", "sale_type", "quantity", types, TOTAL_COLUMN)
    value_cols = [str(t) for t in types] + [TOTAL_COLUMN]
    wide = wide.select("salesperson", *[F.col(f"`{c}`").cast("long").alias(c) for c in value_cols])
    out = append_total_row(wide, "salesperson", TOTALS_LABEL,
                           {c: F.coalesce(F.sum(f"`{c}`"), F.lit(0)) for c in value_cols})
    # Report order (O4): by row total, the totals row last.
    return out.orderBy("is_total", F.col(TOTAL_COLUMN).desc(), "salesperson")


def available_years(orders: DataFrame) -> DataFrame:
    """Distinct notice years, NULL years dropped (R5). Display order: newest first."""
    years = (orders.where(F.col("notice_date_txt").isNotNull())
             .select(F.year(try_date("notice_date_txt")).alias("year"))
             .where(F.col("year").isNotNull()).distinct())
    return years.orderBy(F.col("year").desc())


# --- R18: the four suggested questions -------------------------------------

def best_seller(orders: DataFrame, year: int) -> DataFrame:
    """Who sold most in a year: distinct active orders by notice year, top 1."""
    active = active_orders(orders).where(period(notice_date(orders), year, None))
    per = (active.where(F.col("order_id").isNotNull()).select("salesperson", "order_id").distinct()
           .groupBy("salesperson").agg(F.count(F.lit(1)).cast("long").alias("sales")))
    per = per.select(F.coalesce("salesperson", F.lit(NO_SALESPERSON)).alias("salesperson"), "sales")
    return top_k(per, F.col("sales"), 1, [F.col("salesperson").asc()])


def pending_count(orders: DataFrame) -> DataFrame:
    """Active orders without a file number."""
    return (active_orders(orders).where(F.col("file_no").isNull())
            .agg(F.count_distinct("order_id").cast("long").alias("pending")))


def gp3_avg_by_salesperson(orders: DataFrame) -> DataFrame:
    """Average gross profit 3 per salesperson over active orders, 2 decimals."""
    return (active_orders(orders).groupBy("salesperson")
            .agg(F.try_divide(F.sum("gp3").cast("double"), F.count("gp3").cast("double")).alias("avg_gp3"))
            .select(F.coalesce("salesperson", F.lit(NO_SALESPERSON)).alias("salesperson"),
                    round_half_away("avg_gp3", 2).alias("avg_gp3")))


def top_sale_type(orders: DataFrame) -> DataFrame:
    """Most frequent sale type among active orders (ties: by name)."""
    per = (active_orders(orders).groupBy("sale_type").agg(F.count(F.lit(1)).cast("long").alias("orders"))
           .select(F.coalesce("sale_type", F.lit(NO_SALE_TYPE)).alias("sale_type"), "orders"))
    return top_k(per, F.col("orders"), 1, [F.col("sale_type").asc()])

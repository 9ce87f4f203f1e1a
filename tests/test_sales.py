"""Sales reports: edge cases and equivalences."""

from pyspark.sql import functions as F

from dealbook.operators.joins import keyed, left_join_spread
from dealbook.plans import sales

ORDER_SCHEMA = ("order_id long, order_no string, state_code int, salesperson string, vin long, file_no long, "
                "order_date_txt string, notice_date_txt string, sale_type string, gp1 decimal(18,2), "
                "gp2 decimal(18,2), gp3 decimal(19,2), discount double, financed_amount decimal(18,2)")


def _orders(spark, rows):
    from decimal import Decimal

    def dec(v):
        return None if v is None else Decimal(v)

    fixed = [r[:9] + (dec(r[9]), dec(r[10]), dec(r[11]), r[12], dec(r[13])) for r in rows]
    return spark.createDataFrame(fixed, ORDER_SCHEMA)


def test_literal_label_and_null_salesperson_stay_apart(spark):
    rows = [(1, "P1", 0, "Sin asignar", 1, 1, "2024-01-02", "2024-01-05", "A", 10, 1, 1, 0.1, 5),
            (2, "P2", 0, None, 2, None, "2024-01-02", "2024-01-05", "B", 20, None, 2, None, None)]
    stock = spark.createDataFrame([(1, None), (2, None)], "vin long, registration_date date")
    out = sales.salesperson_summary(_orders(spark, rows), stock).collect()
    assert sorted(r.salesperson for r in out) == ["Sin asignar", "Sin asignar"]
    pivot = sales.type_pivot(_orders(spark, rows)).collect()
    body = [r for r in pivot if not r.is_total]
    assert len(body) == 1 and body[0]["TOTAL"] == 2


def test_summary_rules(spark):
    rows = [
        # active, plated (stock has a date), uploaded, in May 2024 by notice date
        (1, "P1", 0, "ann", 1, 9, "2024-04-20", "2024-05-10", "A", 100, None, 50, 0.05, 10),
        # same order id twice: counted once, measures summed over rows
        (1, "P1", 0, "ann", 1, 9, "2024-04-20", "2024-05-10", "A", 100, 20, 50, None, 0),
        # pending, order date in May, notice in June
        (2, "P2", 0, "ann", 2, None, "2024-05-03", "2024-06-01", "B", 10, 1, 1, 0.1, None),
        # inactive and not-an-order rows are ignored
        (3, "P3", 1, "ann", 3, 9, "2024-05-03", "2024-05-03", "B", 10, 1, 1, 0.1, 1),
        (4, None, 0, "ann", 4, 9, "2024-05-03", "2024-05-03", "B", 10, 1, 1, 0.1, 1),
        # outside the period entirely: salesperson bob disappears (HAVING)
        (5, "P5", 0, "bob", None, 9, "2023-01-01", "2023-01-05", "B", 10, 1, 1, 0.1, 1),
    ]
    stock = spark.createDataFrame([(1, None), (1, __import__("datetime").date(2024, 1, 1)), (2, None)],
                                  "vin long, registration_date date")
    out = {r.salesperson: r for r in sales.salesperson_summary(_orders(spark, rows), stock, 2024, 5).collect()}
    assert set(out) == {"ann"}
    a = out["ann"]
    assert (a.plated, a.uploaded, a.pending, a.orders, a.sales, a.financed) == (1, 1, 0, 1, 1, 1)
    assert a.sum_gp1 == 200.0 and a.avg_gp1 == 100.0
    assert a.sum_gp2 == 20.0 and a.avg_gp2 == 10.0       # NULL gp2 counts as 0
    assert a.avg_discount_pct == 2.5                     # (5 + 0) / 2


def test_prefilter_equals_unfiltered_plan(spark, tables):
    """The period prefilter must not change the result."""
    filtered = sales.salesperson_summary(tables.sales_orders, tables.vehicle_stock, 1997, 5)
    base = sales.order_base(tables.sales_orders, tables.vehicle_stock)
    n = F.year("notice_date") == 1997
    n = n & (F.month("notice_date") == 5)
    direct = (base.groupBy("salesperson").agg(
        F.count_distinct(F.when(n, F.col("order_id"))).alias("sales"),
        F.count_distinct(F.when((F.year("order_date") == 1997) & (F.month("order_date") == 5),
                                F.col("order_id"))).alias("orders"))
        .where((F.col("sales") > 0) | (F.col("orders") > 0))
        .select(F.coalesce("salesperson", F.lit("Sin asignar")).alias("salesperson"), "sales", "orders"))
    assert sorted(map(tuple, filtered.select("salesperson", "sales", "orders").collect())) == \
        sorted(map(tuple, direct.collect()))


def test_shares_sum_to_100(spark, tables):
    rows = sales.sales_by_type(tables.sales_orders, 1997).collect()
    per = {}
    for r in rows:
        per[r.salesperson] = per.get(r.salesperson, 0) + r.share_pct
    for total in per.values():
        assert abs(total - 100) <= 0.05 * 6 + 1e-9


def test_null_keys_match_nothing(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c")], "k long, v string")
    right = spark.createDataFrame([(1, True), (None, False)], "k long, hit boolean")
    out = sorted(left_join_spread(left, keyed(right, "k"), "k", ["v"]).collect(), key=lambda r: r.v)
    assert [(r.v, r.hit) for r in out] == [("a", True), ("b", None), ("c", None)]


def test_totals_row_is_mean_of_means(spark, tables):
    out = sales.summary_with_totals(tables.sales_orders, tables.vehicle_stock, 1997).collect()
    body = [r for r in out if not r.is_total]
    total = [r for r in out if r.is_total][0]
    assert total.salesperson == "TOTALES"
    assert total.orders == sum(r.orders for r in body)
    means = [r.avg_gp1 for r in body if r.avg_gp1 is not None]
    assert abs(total.avg_gp1 - sum(means) / len(means)) < 0.006


def test_top_k_is_deterministic(spark, tables):
    a = [r.salesperson for r in sales.top_salespeople(tables.sales_orders, tables.vehicle_stock, "orders", 10, 1997).collect()]
    b = [r.salesperson for r in sales.top_salespeople(tables.sales_orders, tables.vehicle_stock, "orders", 10, 1997).collect()]
    assert a == b and len(a) <= 10


def test_years_newest_first(spark, tables):
    years = [r.year for r in sales.available_years(tables.sales_orders).collect()]
    assert years == sorted(years, reverse=True) and None not in years


def test_repeated_orders_null_and_hot_vins(spark):
    """A third of the VINs is NULL, a third is one VIN, and each order id occurs twice."""
    orders = [(i % 30, f"P{i}", 0, "ANA", None if i % 3 == 0 else 7 if i % 3 == 1 else i, None, "1997-05-01",
               "1997-05-20", "x", 1, 1, 1, 0.0, 0) for i in range(60)]
    schema = ("order_id long, order_no string, state_code int, salesperson string, vin long, file_no long, order_date_txt string, "
              "notice_date_txt string, sale_type string, gp1 int, gp2 int, gp3 int, discount double, financed_amount int")
    stock = spark.createDataFrame([(7, "1997-01-01"), (7, None), (5, "1997-01-01")], "vin long, d string").selectExpr(
        "vin", "cast(d as date) as registration_date")
    row = sales.salesperson_summary(spark.createDataFrame(orders, schema), stock, 1997, 5).collect()
    plated = {i % 30 for i in range(60) if i % 3 == 1 or i == 5}
    assert [(r.orders, r.sales, r.plated, r.pending, r.sum_gp1) for r in row] == [(30, 30, len(plated), 30, 60.0)]


def test_reserved_pivot_names_are_refused(spark, tables):
    import pytest

    with pytest.raises(ValueError):
        sales.type_pivot(tables.sales_orders, 1997, types=["LOW", "TOTAL"])


def test_report_orders(spark, tables):
    rows = sales.summary_with_totals(tables.sales_orders, tables.vehicle_stock, 1997).collect()
    assert rows[-1].is_total and not any(r.is_total for r in rows[:-1])
    assert [r.orders for r in rows[:-1]] == sorted((r.orders for r in rows[:-1]), reverse=True)
    piv = sales.type_pivot(tables.sales_orders, 1997).collect()
    assert piv[-1].salesperson == "TOTALES"
    assert [r["TOTAL"] for r in piv[:-1]] == sorted((r["TOTAL"] for r in piv[:-1]), reverse=True)
    shares = sales.sales_by_type(tables.sales_orders, 1997).collect()
    assert [r.salesperson for r in shares] == sorted(r.salesperson for r in shares)


def test_latest_row_and_value(spark):
    import datetime as dt

    from dealbook.operators.latest import latest_row, latest_value

    df = spark.createDataFrame([(1, None, "a"), (1, dt.date(2024, 1, 1), "b"), (1, dt.date(2023, 1, 1), "c"),
                                (2, None, "d")], "vin long, d date, tag string")
    rows = {r.vin: r for r in latest_row(df, "vin", "d").collect()}
    assert rows[1].tag == "b" and rows[2].tag == "d" and rows[2].d is None
    vals = {r.vin: r.d for r in latest_value(df, "vin", "d").collect()}
    assert vals == {1: dt.date(2024, 1, 1), 2: None}


def test_null_keys_go_to_many_partitions_and_the_left_side_is_read_once(spark):
    left = spark.range(40_000).selectExpr("case when id % 3 = 0 then id end as k", "id as v")
    right = keyed(spark.range(40_000).selectExpr("id as k", "true as hit"), "k")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = left_join_spread(left, right, "k", ["v"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        sizes = out.where("k is null").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("Range (") == 2
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 2 * 26_666 / 8


def test_bucketed_tables_join_without_a_shuffle_and_give_the_same_summary(spark, tables):
    import tempfile

    orders, stock = tables.sales_orders_dirty, tables.vehicle_stock
    want = sorted(map(tuple, sales.salesperson_summary(orders, stock, 1997, 5).collect()))
    path = tempfile.mkdtemp(prefix="dealbook-test-")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = sales.bucketed_sales_tables(orders, stock, path, 4, "test_sales")
        assert sorted(map(tuple, sales.salesperson_summary(*stored, 1997, 5).collect())) == want
        base = sales.order_base(*stored)
        plan = base._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("FileScan") == 2
        empty = [r["n"] for r in stored[0].where("vin is null").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
        assert len(empty) == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        for t in ("test_sales_orders_by_vin", "test_sales_stock_by_vin"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_buckets_grow_with_the_orders_and_cut_a_frequent_vin(spark, tables):
    import tempfile

    orders, stock = tables.sales_orders_dirty, tables.vehicle_stock.unionByName(tables.vehicle_stock)
    assert orders.where("vin = 7").count() > 500
    want = sorted(map(tuple, sales.salesperson_summary(orders, stock, 1997).collect()))
    path = tempfile.mkdtemp(prefix="dealbook-test-")
    try:
        stored = sales.bucketed_sales_tables(orders, stock, path, 4, "test_grown", bucket_rows=100, piece_rows=20)
        assert sorted(map(tuple, sales.salesperson_summary(*stored, 1997).collect())) == want
        sizes = [r["n"] for r in stored[0].groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == orders.count() and len(sizes) >= orders.count() / 100 and max(sizes) <= 250
        assert stored[0].select(*orders.columns).exceptAll(orders).count() == 0
    finally:
        for t in ("test_grown_orders_by_vin", "test_grown_stock_by_vin"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_month_report_reads_one_month_of_folders(spark, tables):
    import tempfile

    from dealbook.plans import periods

    orders, stock = tables.sales_orders, tables.vehicle_stock
    stored = periods.store_by_period(orders, tempfile.mkdtemp(prefix="dealbook-test-") + "/o")
    for year, month in ((1997, 5), (1997, None), (None, 5), (None, None)):
        assert sorted(map(tuple, sales.salesperson_summary(stored.orders(year, month), stock, year, month).collect())) == \
            sorted(map(tuple, sales.salesperson_summary(orders, stock, year, month).collect()))
        assert sorted(map(tuple, sales.sales_by_type(stored.orders(year, month, False), year, month).collect())) == \
            sorted(map(tuple, sales.sales_by_type(orders, year, month).collect()))
    read = stored.orders(1997, 5, by_order=False)
    assert {r.notice_month for r in read.select("notice_month").distinct().collect()} == {199705}
    read = stored.orders(1997, 5)
    read.collect()
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(notice_month" in plan and "dynamicpruning" in plan
    assert {r.notice_month for r in read.select("notice_month").distinct().collect()} <= {
        r.notice_month for r in stored.index().where("order_month = 199705 or notice_month = 199705").collect()}


def test_batches_in_any_order_equal_the_full_summary(spark, tables):
    import os
    import tempfile

    from dealbook.plans import incremental

    orders, stock = tables.sales_orders_dirty, tables.vehicle_stock
    parts = [orders.where(F.pmod(F.xxhash64("order_id", "vin"), F.lit(3)) == k) for k in range(3)]
    # An order that comes again in another batch, with other values.
    parts[1] = parts[1].unionByName(parts[0].limit(20).withColumn("gp1", (F.col("gp1") + 1).cast("decimal(18,2)")))
    parts = [p.cache() for p in parts]
    everything = parts[0].unionByName(parts[1]).unionByName(parts[2])
    wants = {(y, m): sorted(map(tuple, sales.salesperson_summary(everything, stock, y, m).collect()))
             for y, m in ((1997, 5), (None, None))}
    for order in ((0, 1, 2), (2, 1, 0)):
        state = incremental.SummaryState(spark, tempfile.mkdtemp(prefix="dealbook-test-"))
        for k in order:
            state.add(str(k), parts[k])
        state.add(str(order[0]), parts[order[0]])   # again: it replaces itself
        assert len([d for d in os.listdir(state.path) if d.startswith("batch=")]) == 3
        for (y, m), want in wants.items():
            assert sorted(map(tuple, state.summary(stock, y, m).collect())) == want

"""Landing readers, writers and the guarded SELECT."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from dealbook.plans import adhoc, etl, roundtrips
from dealbook.sources import landing, sinks, tables as tbl


def _tmp():
    return tempfile.mkdtemp(prefix="dealbook-test-")


def _lines(root):
    return [ln for f in sorted(os.listdir(root)) if f.endswith(".txt")
            for ln in open(os.path.join(root, f)).read().splitlines()]


def test_ledger_files_aligned_by_name_and_corrupt_file_skipped(spark, tables):
    root = _tmp()
    raw = tables.ledger_raw.limit(40).cache()
    names = [r.source_name for r in raw.select("source_name").distinct().limit(2).collect()]
    a = raw.where(F.col("source_name") == names[0]).drop("source_name")
    b = raw.where(F.col("source_name") == names[1]).drop("source_name", "centre")   # drifting columns
    for name, part in ((names[0], a), (names[1], b)):
        d = os.path.join(root, "tmp-" + name)
        part.coalesce(1).write.parquet(d)
        f = [x for x in os.listdir(d) if x.endswith(".parquet")][0]
        os.replace(os.path.join(d, f), os.path.join(root, name + ".parquet"))
    with open(os.path.join(root, "broken.parquet"), "wb") as fh:
        fh.write(os.urandom(256))
    df = landing.read_ledger_files(spark, os.path.join(root, "*.parquet"), "parquet")
    assert set(df.columns) >= {"source_name", "centre", "account"}
    got = df.groupBy("source_name").agg(F.count("*").alias("n"), F.count("centre").alias("c")).collect()
    by = {r.source_name: r for r in got}
    assert by[names[1]].c == 0 and by[names[0]].n == a.count()
    assert set(by) == set(names)
    assert [r.file_path.rsplit("/", 1)[1] for r in
            landing.skipped_ledger_files(spark, os.path.join(root, "*.parquet")).collect()] == ["broken.parquet"]


def test_csv_columns_go_by_name_and_bad_rows_are_reported(spark):
    root = _tmp()
    texts = {"A_MM011997_v1.xlsx.csv": "account,category,monthly_balance_txt,section\n6001,A1,1.5,1\n",
             "B_MM021997_v1.xlsx.csv": "monthly_balance_txt,extra,category,account\n2.5,z,A2,6002\n9,z,A3,6003\n",
             "C_MM031997_v1.xlsx.csv": "account,monthly_balance_txt,section\n6004,4.0,1\nbad,row\n6005,1.0,notanumber\n"}
    for name, text in texts.items():
        with open(os.path.join(root, name), "w") as fh:
            fh.write(text)
    schema = "account string, section int, category string, monthly_balance_txt string"
    got = sorted((r.source_name, r.account, r.section, r.category, r.monthly_balance_txt)
                 for r in landing.read_ledger_files(spark, root, "csv", schema).collect())
    assert got == [("A_MM011997_v1.xlsx", "6001", 1, "A1", "1.5"), ("B_MM021997_v1.xlsx", "6002", None, "A2", "2.5"),
                   ("B_MM021997_v1.xlsx", "6003", None, "A3", "9"), ("C_MM031997_v1.xlsx", "6004", 1, None, "4.0")]
    bad = sorted((r.source_name, r.row) for r in landing.rejected_ledger_rows(spark, root, schema).collect())
    assert bad == [("C_MM031997_v1.xlsx", "6005,1.0,notanumber"), ("C_MM031997_v1.xlsx", "bad,row")]


def test_month_rows_add_up_to_the_total(spark, tables):
    from dealbook.plans import statement

    ledger = etl.transform_ledger(tables.ledger_raw, {"BalanceAlpha": "ALPHA MOTOR"})
    long = statement.pnl_long(spark, ledger, tables.statement_template, "ALPHA MOTOR", 1997).collect()
    assert "13" in {r.period for r in long}
    for line in {r.category for r in long}:
        months = sum(r.value for r in long if r.category == line and r.period != "Total")
        assert abs(months - next(r.value for r in long if r.category == line and r.period == "Total")) < 0.01


def test_shared_folder_is_required_off_local_masters():
    from types import SimpleNamespace

    from dealbook.session import ensure_checkpoint_dir

    far = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(far)


def test_budget_source_names_are_renamed(spark):
    raw = spark.createDataFrame([("A1", 5.0, 0.1, 1, "2024", "3", "c")],
                                "cgib_categoria string, cgib_totalbase double, cgib_valorporcentaje double, "
                                "cgib_empresa int, cgib_ano string, cgib_mes string, cgib_concepto string")
    row = etl.transform_budget(raw).first()
    assert (row.category, row.base_total, row.percent_value, row.company_code, row.concept, row.month_text) == (
        "A1", 5.0, 0.1, 1, "c", "Marzo")


def test_ledger_transform_rules(spark):
    raw = spark.createDataFrame(
        [("BalanceAlpha_MM011997_v1.xlsx", "6001", None, "1.5"), ("BalanceX_MM131997_v1.XLS", "6002", "A1", "n/a"),
         ("BalanceY.xlsx", "6003", "A2", "2")],
        "source_name string, account string, category string, monthly_balance_txt string")
    out = {r.account: r for r in etl.transform_ledger(raw, {"BalanceAlpha": "ALPHA"}).collect()}
    a, x, y = out["6001"], out["6002"], out["6003"]
    assert (a.company, a.month, a.year, a.month_name, a.category, a.monthly_balance) == \
        ("ALPHA", 1, 1997, "ENERO", "without_category", 1.5)
    assert a.report_date.isoformat() == "1997-01-01" and a.account_key == "6001--"
    assert (x.company, x.month, x.month_name, x.report_date, x.monthly_balance) == ("BalanceX", 13, None, None, None)
    assert (y.company_code, y.date_part, y.month, y.year) == ("BalanceY", "", None, None)


def test_budget_transform_filters(spark, tables):
    out = etl.transform_budget(tables.budget_raw)
    assert out.where(F.col("category").contains("T")).count() == 0
    assert out.where(F.upper("month").isin("ACUMULADO", "MESACUMULADO", "TOTAL")).count() == 0
    assert out.where(F.lower("month_text") == "total").count() == 0


def test_json_pages_roundtrip(spark, tables):
    out = roundtrips.load_json_pages(tables.category_raw)
    assert out.count() == tables.category_raw.count()
    assert "label" in out.columns and not any(c.startswith("@") for c in out.columns)


def test_multiline_json_pages(spark):
    root = _tmp()
    with open(os.path.join(root, "p1.json"), "w") as fh:
        fh.write('{\n "value": [ {"identifier": "B1", "name": "x", "@odata.etag": "1"},\n'
                 '  {"identifier": null, "name": "y"} ],\n "@odata.nextLink": "p2"\n}\n')
    df = landing.read_json_pages(spark, root, "identifier string, name string, `@odata.etag` string", multiline=True)
    assert sorted(((r.identifier or ""), r.name) for r in df.collect()) == [("", "y"), ("B1", "x")]
    assert "@odata.etag" not in df.columns


def _joined(spark, root):
    """The export's bytes as its manifest puts them together."""
    told = sinks.export_manifest(spark, root)
    out = b""
    for part in told["parts"]:
        assert part["offset"] == len(out)
        with open(os.path.join(root, part["part"]), "rb") as fh:
            out += fh.read(part["bytes"])
    assert len(out) == told["bytes"]
    return out.decode()


def test_delimited_export_format(spark):
    root = _tmp() + "/x"
    df = spark.createDataFrame([("a;b", None, 1.5, True)], "x string, y string, z double, w boolean")
    sinks.write_delimited(df, root)
    assert _joined(spark, root) == "x;y;z;w\na;b;;1.5;true"


def test_delimited_export_of_one_null_is_an_empty_line(spark):
    root = _tmp() + "/x"
    sinks.write_delimited(spark.createDataFrame([(None,), (None,)], "x string"), root)
    assert _joined(spark, root) == "x\n\n"
    sinks.write_delimited(spark.createDataFrame([], "x string, y int"), root + "0")
    assert _joined(spark, root + "0") == "x;y"


def test_numbers_are_written_out(spark):
    values = [1.0, -2.5, 0.1, 1e7, 12345678.9, 1e15 + 0.5, 1e20, 1.5e-5, -0.0, float("nan"), None, 123456789012.25]
    got = [r.t for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
           .select(sinks.plain_text(F.col("v"), spark.range(1).select(F.lit(1.0)).schema[0].dataType).alias("t")).collect()]
    assert got == ["1", "-2.5", "0.1", "10000000", "12345678.9", "1000000000000000.5", "100000000000000000000",
                   "0.000015", "0", "", "", "123456789012.25"]
    one = spark.sql("select cast(12.50 as decimal(18,2)) as a, cast(7 as decimal(18,2)) as b, 100 as c, 1e0 as d")
    root = _tmp() + "/x"
    sinks.write_delimited(one, root)
    assert _joined(spark, root) == "a;b;c;d\n12.5;7;100;1"


def test_parts_in_order_are_the_whole_text(spark, tables):
    rows = tables.sales_orders.select("order_id", "salesperson", "gp1").repartition(7)
    root = _tmp() + "/x"
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sinks.write_delimited(rows, root, [F.col("gp1").desc(), "order_id"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(sinks.export_manifest(spark, root)["parts"]) > 4

    def number(v):
        return str(v).rstrip("0").rstrip(".")

    want = ["order_id;salesperson;gp1"] + [f"{r.order_id};{r.salesperson or ''};{number(r.gp1)}" for r in sorted(
        rows.collect(), key=lambda r: (-r.gp1, r.order_id))]
    assert _joined(spark, root) == "\n".join(want)
    back = sinks.read_delimited(spark, root, "order_id long, salesperson string, gp1 decimal(18,2)")
    assert back.exceptAll(rows).count() == 0 and back.count() == rows.count()


def test_statement_export_is_a_file_in_template_order(spark, tables):
    from dealbook.plans import statement

    export = statement.pnl_export(spark, tables.ledger, tables.statement_template, "EUROPE", 1997)
    root = _tmp() + "/x"
    sinks.write_delimited(export, root)
    lines = _joined(spark, root).split("\n")
    assert lines[0].startswith("Categoría;Concepto;Enero Resultado;Enero %;") and lines[0].endswith("Total Resultado;Total %")
    concepts = [r.concept for r in tables.statement_template.orderBy("n").collect()]
    assert [ln.split(";")[1] for ln in lines[1:]] == concepts
    assert [r.text for r in roundtrips.export_lines(export).orderBy("line").collect()] == lines


def _pages(root, pages):
    for name, (values, link) in pages.items():
        tail = f', "@odata.nextLink": "https://host/api/{link}"' if link else ""
        with open(os.path.join(root, name + ".json"), "w") as fh:
            fh.write('{"value": [' + ", ".join(f'{{"identifier": "{v}", "name": "n"}}' for v in values) + "]" + tail + "}\n")


def test_page_chains_are_followed(spark):
    schema = "identifier string, name string"
    good = {"p1": (["A", "B"], "p2"), "p2": ([], "p3"), "p3": (["C"], None)}

    def read(pages, extra=None):
        root = _tmp()
        _pages(root, pages)
        return sorted(r.identifier for r in landing.read_json_pages(spark, root, schema, chained=True).collect())

    assert read(good) == ["A", "B", "C"]
    assert read({"p1": (["A"], None)}) == ["A"]
    with pytest.raises(ValueError, match="p2 is missing"):
        read({k: v for k, v in good.items() if k != "p2"})
    with pytest.raises(ValueError, match="p3"):
        read({**good, "p4": (["D"], "p3")})
    with pytest.raises(ValueError, match="p4"):
        read({**good, "p4": (["D"], None)})
    with pytest.raises(ValueError, match="no first page"):
        read({**good, "p3": (["C"], "p1")})
    pages = spark.createDataFrame([("p1", "p2"), ("p2", None), ("p2", None)], "page string, next string")
    with pytest.raises(ValueError, match="p2 is there more than once"):
        landing.check_page_chain(pages)


def test_landed_pages_are_one_chain_of_full_pages(spark, tables):
    path = roundtrips.land_json_pages(tables.category_raw.repartition(5), page_size=30)
    n = tables.category_raw.count()
    pages = spark.read.json(path)
    sizes = sorted(pages.select(F.size("value").alias("n")).toPandas()["n"])
    assert sum(sizes) == n and sizes[1:] == [30] * (len(sizes) - 1)
    assert landing.read_json_pages(spark, path, "identifier string, name string", chained=True).count() == n


def test_overwrite_replaces_and_counts(spark, tables):
    out = roundtrips.overwrite_count(tables.statement_template).collect()
    assert out[0].rows == 22
    path = _tmp() + "/t"
    assert sinks.overwrite_table(tables.statement_template, path) == 22
    assert sinks.overwrite_table(tables.statement_template.limit(5), path) == 5   # replaced, not appended


def test_nan_to_null_and_json(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 2.0)], "k int, v double")
    assert [r.v for r in sinks.nan_to_null(df).orderBy("k").collect()] == [None, 2.0]
    js = [r.json for r in sinks.to_json_records(df).collect()]
    assert '{"k":1}' in js
    nested = spark.createDataFrame([([1.0, float("nan")], (float("nan"), "x"))], "`a.b` array<double>, s struct<v:double,t:string>")
    row = sinks.nan_to_null(nested).first()
    assert row["a.b"] == [1.0, None] and tuple(row.s) == (None, "x")


def test_template_sheet_types(spark, tables):
    out = roundtrips.load_template_sheet(tables.template_raw)
    rows = {r.concept: r.n for r in out.collect()}
    assert rows["New bonus"] is None and rows["P&L"] == 22
    ordered = [r.n for r in tbl.ordered_template(out).collect()]
    assert ordered[-1] is None and ordered[:3] == [1, 2, 3]


def test_guarded_select(spark, tables):
    tbl.register_views(spark, {"so": tables.sales_orders})
    assert adhoc.guarded_select(spark, "SELECT * FROM so").count() == 50
    with pytest.raises(ValueError):
        adhoc.guarded_select(spark, "DROP VIEW so")
    with pytest.raises(ValueError):
        adhoc.guarded_select(spark, "SELECT * FROM no_such_table")
    path = _tmp() + "/tgt"
    spark.range(3).write.parquet(path)
    with pytest.raises(ValueError):
        adhoc.guarded_select(spark, f"WITH x AS (SELECT 9L AS id) INSERT INTO parquet.`{path}` SELECT id FROM x")
    assert spark.read.parquet(path).count() == 3
    assert adhoc.guarded_select(spark, "WITH x AS (SELECT 1 AS a) SELECT a FROM x").count() == 1
    assert "so" in [r.name for r in tbl.list_tables(spark).collect()]


def test_partition_reload_replaces_only_its_year(spark):
    path = _tmp() + "/ledger"
    df = spark.createDataFrame([(1997, "A1", 1.0), (1997, "A2", 2.0), (1998, "A1", 3.0)],
                               "year int, category string, monthly_balance double")
    assert sinks.overwrite_table(df, path, partition_by=["year"]) == 3
    reload = spark.createDataFrame([(1998, "A9", 9.0)], "year int, category string, monthly_balance double")
    assert sinks.overwrite_table(reload, path, partition_by=["year"], replace_partitions_only=True) == 3
    got = sorted((r.year, r.category) for r in sinks.read_table(spark, path).collect())
    assert got == [(1997, "A1"), (1997, "A2"), (1998, "A9")]
    pruned = sinks.read_table(spark, path).where(F.col("year") == 1997)
    assert "PartitionFilters: [isnotnull(year" in pruned._jdf.queryExecution().executedPlan().toString()
    assert pruned.count() == 2


def _fails_half_way(spark):
    """Two tasks, of which one writes its rows and the other fails."""
    return spark.range(0, 20_000, 1, 2).selectExpr(
        "case when id = 19999 then raise_error('lost') else 2000 end as year", "'A1' as category", "1.0D as monthly_balance")


def test_failed_replace_leaves_the_old_table(spark):
    path = _tmp() + "/ledger"
    schema = "year int, category string, monthly_balance double"
    rows = [(1997, "A1", 1.0), (1998, "A2", 2.0)]
    for how in ({}, {"partition_by": ["year"]}):
        at = path + str(len(how))
        assert sinks.overwrite_table(spark.createDataFrame(rows, schema), at, **how) == 2
        with pytest.raises(Exception):
            sinks.overwrite_table(_fails_half_way(spark), at, **how)
        assert sorted(map(tuple, sinks.read_table(spark, at).collect())) == rows
        assert sinks.overwrite_table(spark.createDataFrame(rows[:1], schema), at, **how) == 1
        assert sorted(map(tuple, sinks.read_table(spark, at).collect())) == rows[:1]


def test_readers_keep_their_version_and_older_ones_go(spark):
    path = _tmp() + "/t"
    for k in range(5):
        sinks.overwrite_table(spark.range(k, k + 1), path)
        if k == 3:
            begun = sinks.read_table(spark, path)
    assert [r.id for r in begun.collect()] == [3]
    assert [r.id for r in sinks.read_table(spark, path).collect()] == [4]
    assert len([d for d in os.listdir(path) if d.startswith("v")]) == 2
    with pytest.raises(ValueError):
        sinks.read_table(spark, path + "-none")


def test_second_writer_from_one_version_is_refused(spark):
    from dealbook.sources import versioned

    path = _tmp() + "/t"
    sinks.overwrite_table(spark.range(1), path)
    versioned._write_commit(spark, path, 2, {"folders": {}, "rows": 0, "schema": spark.range(0).schema.jsonValue()})
    with pytest.raises(Exception):
        versioned._write_commit(spark, path, 2, {"folders": {}})
    assert sinks.read_table(spark, path).count() == 0
    with open(os.path.join(path, "_commits", "000000000003.json"), "w") as fh:
        fh.write('{"folders": {"": "v0')   # a writer lost half-way
    assert sinks.read_table(spark, path).count() == 0
    assert sinks.overwrite_table(spark.range(7), path) == 7


def test_empty_partitioned_table_is_readable(spark):
    path = _tmp() + "/t"
    empty = spark.createDataFrame([], "year int, category string")
    assert sinks.overwrite_table(empty, path, partition_by=["year"]) == 0
    assert sinks.read_table(spark, path).columns == ["year", "category"]


@pytest.fixture
def views(spark, tables):
    tbl.register_views(spark, {"so": tables.sales_orders, "led": tables.ledger})
    return {"so", "led"}


@pytest.mark.parametrize("sql", [
    "SELECT salesperson, COUNT(*) AS n, ROUND(AVG(gp1), 2) AS a FROM so GROUP BY ALL HAVING COUNT(*) > 1 ORDER BY n DESC",
    "WITH a AS (SELECT * FROM so), b AS (SELECT salesperson FROM a) SELECT DISTINCT salesperson FROM b",
    "SELECT * FROM so WHERE vin IN (SELECT centre FROM led) OR order_id = (SELECT MAX(section) FROM led)",
    "SELECT a.order_id, ROW_NUMBER() OVER (PARTITION BY a.salesperson ORDER BY a.gp1) AS r FROM so a JOIN SO b USING (order_id)",
    "SELECT CASE WHEN gp2 IS NULL THEN 'x' ELSE CAST(gp2 AS STRING) || '!' END AS t, -gp1 % 3 FROM so UNION ALL SELECT 'a', 1",
    "SELECT x.a FROM (SELECT explode(array(1, 2)) AS a) x",
    "SELECT so.order_id, x FROM so LATERAL VIEW explode(array(1, 2)) t AS x",
    "SELECT 1 AS one"])
def test_queries_over_views_are_allowed(spark, views, sql):
    adhoc.guarded_select(spark, sql, views=views).collect()


@pytest.mark.parametrize("call", [
    "reflect('java.lang.System', 'getProperty', 'user.home')", "java_method('java.lang.System', 'currentTimeMillis')",
    "try_reflect('java.lang.System', 'currentTimeMillis')", "input_file_name()", "current_user()", "version()",
    "(SELECT reflect('java.lang.System', 'currentTimeMillis'))", "sum(length(java_method('java.lang.Math', 'random')))"])
def test_calls_outside_the_list_are_refused(spark, views, call):
    for sql in (f"SELECT {call} FROM so", f"WITH w AS (SELECT {call} AS a FROM so) SELECT a FROM w",
                f"SELECT 1 FROM so WHERE EXISTS (SELECT {call})"):
        with pytest.raises(ValueError):
            adhoc.guarded_select(spark, sql, views=views)


def test_only_registered_views_are_read(spark, views, tables):
    path = _tmp() + "/t"
    spark.range(3).write.parquet(path)
    table = "adhoc_secret"
    spark.range(3).write.mode("overwrite").option("path", _tmp() + "/s").saveAsTable(table)
    try:
        for source in (f"parquet.`{path}`", f"text.`{path}`", table, f"spark_catalog.default.{table}", "range(3)",
                       f"(SELECT * FROM {table})", "so LATERAL VIEW sql_keywords() k AS a, b"):
            with pytest.raises(ValueError):
                adhoc.guarded_select(spark, f"SELECT * FROM {source}", views=views)
            with pytest.raises(ValueError):
                adhoc.guarded_select(spark, f"SELECT * FROM so WHERE order_id IN (SELECT 1 FROM {source})", views=views)
        tbl.register_views(spark, {"hidden": tables.category_raw})
        with pytest.raises(ValueError):
            adhoc.guarded_select(spark, "SELECT * FROM hidden", views=views)
        assert adhoc.guarded_select(spark, "SELECT * FROM hidden", views={"hidden"}).count() == 50
        # A name given by WITH does not open a table of that name to other queries.
        with pytest.raises(ValueError):
            adhoc.guarded_select(spark, f"WITH x AS (SELECT * FROM {table}) SELECT * FROM x", views=views)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def _data_files(root):
    return [os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.startswith("part-")]


@pytest.mark.parametrize("tasks", [16, 64])
def test_landed_files_follow_names_and_bytes_not_tasks(spark, tables, tasks):
    raw = tables.ledger_raw.repartition(tasks).cache()
    names = raw.select("source_name").distinct().count()
    path = landing.land_ledger_files(raw, _tmp())
    assert len(_data_files(path + "/" + next(d for d in os.listdir(path) if d.startswith("layout=")))) <= names + 1
    back = landing.read_ledger_files(spark, path, "csv", roundtrips.LEDGER_FILE_SCHEMA)
    cols = raw.columns
    kind = {f.name: f.dataType for f in back.schema.fields}
    want = raw.select(*[F.col(c).cast(kind[c]) for c in cols])
    assert back.select(*cols).exceptAll(want).count() == 0 and want.exceptAll(back.select(*cols)).count() == 0
    raw.unpersist()


def test_layouts_of_one_folder_are_read_by_their_manifest(spark):
    path = _tmp()
    a = spark.createDataFrame([("A_MM011997_v1.xlsx", "6001", "1.5", "x")], "source_name string, account string, monthly_balance_txt string, extra string")
    b = spark.createDataFrame([("B_MM021997_v1.xlsx", "2.5", "A2", "6002"), ("C+%20 d.xlsx", None, "A3", "6003")],
                              "source_name string, monthly_balance_txt string, category string, account string")
    for df in (a, b, a):  # a name landed again replaces its files
        landing.land_ledger_files(df, path)
    got = sorted(map(tuple, landing.read_ledger_files(
        spark, path, "csv", "account string, category string, monthly_balance_txt string").collect()))
    assert got == [("6001", None, "1.5", "A_MM011997_v1.xlsx"), ("6002", "A2", "2.5", "B_MM021997_v1.xlsx"),
                   ("6003", "A3", None, "C+%20 d.xlsx")]


def test_accounted_load_tells_of_every_row_and_file(spark):
    import gzip

    root = _tmp()
    texts = {"A_MM011997_v1.xlsx.csv": "﻿account,category,monthly_balance_txt,section\n6001,A1,1.5,1\n6002,A1,n/a,1\n",
             "sub/B_MM021997_v1.xlsx.csv": "monthly_balance_txt,extra,category,account,extra\n2.5,z,A2,6003,y\n",
             "C_MM031997_v1.xlsx.csv": "account,monthly_balance_txt,section\n6004,4.0,1\nbad,row\n6005,1.0,notanumber\n",
             "empty.csv": ""}
    os.makedirs(root + "/sub")
    for name, text in texts.items():
        with open(os.path.join(root, name), "w") as fh:
            fh.write(text)
    packed = gzip.compress(b"account,section\n" + os.urandom(5000))
    with open(root + "/D_MM041997_v1.xlsx.csv.gz", "wb") as fh:
        fh.write(packed[:12])
    with open(root + "/E_MM051997_v1.xlsx.csv.gz", "wb") as fh:
        fh.write(gzip.compress(b"account,monthly_balance_txt\n6006,8.0\n"))
    table = _tmp() + "/t"
    (told,) = roundtrips.accounted_load(spark, root, table, "account string, section int, category string, monthly_balance_txt string").collect()
    assert told.asDict() == {"rows": 5, "rejects": 2, "unparsed": 1, "money": 16.0, "stored": 7, "skipped_files": 1}
    kept = {(r.account, r.company_code, r.month) for r in sinks.read_table(spark, table).where("not quarantined").collect()}
    assert kept == {("6001", "A", 1), ("6002", "A", 1), ("6003", "B", 2), ("6004", "C", 3), ("6006", "E", 5)}
    bad = sorted(r._reject for r in sinks.read_table(spark, table).where("quarantined").collect())
    assert bad == ["6005,1.0,notanumber", "bad,row"]


def test_mapping_tables_are_joined_and_checked(spark):
    codes = spark.createDataFrame([("A",), ("B",), (None,), ("Z",)], "code string")
    names = spark.createDataFrame([("A", "Alpha"), ("B", None), (None, "none"), ("C", "Gamma")], "k string, v string")
    got = {r.code: r.name for r in etl.map_codes(codes, "code", "name", names).collect()}
    assert got == {"A": "Alpha", "B": "B", None: None, "Z": "Z"}
    assert got == {r.code: r.name for r in etl.map_codes(codes, "code", "name", {"A": "Alpha"}).collect()}
    with pytest.raises(ValueError, match="A"):
        etl.map_codes(codes, "code", "name", names.unionByName(names))
    raw = spark.createDataFrame([("A_MM011997_v1.xlsx", "6001", None, "1.5")],
                                "source_name string, account string, category string, monthly_balance_txt string")
    assert etl.transform_ledger(raw, names).first().company == "Alpha"


def test_tasks_of_a_load_are_bounded_whatever_the_input(spark, tables, monkeypatch):
    from dealbook.plans import roundtrips
    from dealbook.sources import landing

    key = "spark.sql.files.maxPartitionBytes"
    before, sizes, write = spark.conf.get(key), [], roundtrips.overwrite_table
    want = roundtrips.load_drifted(tables.ledger_raw).collect()

    def told(df, *args, **how):
        sizes.append((int(spark.conf.get(key)), df.rdd.getNumPartitions()))
        return write(df, *args, **how)

    monkeypatch.setattr(roundtrips, "overwrite_table", told)
    monkeypatch.setattr(landing, "READ_BYTES", 20_000)
    monkeypatch.setattr(landing, "FILE_BYTES", 20_000)
    assert roundtrips.load_drifted(tables.ledger_raw).collect() == want
    assert sizes[0][0] == 20_000 and sizes[0][1] > 8
    assert spark.conf.get(key) == before

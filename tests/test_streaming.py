"""Exactly-once ledger ingest from a landing folder."""

import os
import tempfile

from pyspark.sql import functions as F

from dealbook.plans.roundtrips import LEDGER_FILE_SCHEMA
from dealbook.streaming.ledger_ingest import start_ledger_ingest


def test_ingest_processes_each_file_once(spark, tables):
    root = tempfile.mkdtemp(prefix="dealbook-stream-")
    landing, table, ckpt = (os.path.join(root, d) for d in ("landing", "table", "ckpt"))
    raw = tables.ledger_raw.cache()
    names = [r.source_name for r in raw.select("source_name").distinct().orderBy("source_name").limit(3).collect()]

    def land(name):
        raw.where(F.col("source_name") == name).drop("source_name").coalesce(1) \
            .write.parquet(os.path.join(landing, "tmp-" + name))
        d = os.path.join(landing, "tmp-" + name)
        part = [f for f in os.listdir(d) if f.endswith(".parquet")][0]
        os.replace(os.path.join(d, part), os.path.join(landing, name + ".parquet"))

    os.makedirs(landing)
    land(names[0])
    land(names[1])
    q = start_ledger_ingest(spark, os.path.join(landing, "*.parquet"), table, LEDGER_FILE_SCHEMA, checkpoint=ckpt)
    q.awaitTermination()
    first = spark.read.parquet(table).count()
    expected = raw.where(F.col("source_name").isin(names[:2])).count()
    assert first == expected
    land(names[2])
    q = start_ledger_ingest(spark, os.path.join(landing, "*.parquet"), table, LEDGER_FILE_SCHEMA, checkpoint=ckpt)
    q.awaitTermination()
    out = spark.read.parquet(table)
    assert out.count() == raw.where(F.col("source_name").isin(names)).count()
    assert {r.source_name for r in out.select("source_name").distinct().collect()} == set(names)


def test_csv_ingest(spark, tables):
    root = tempfile.mkdtemp(prefix="dealbook-stream-csv-")
    landing, table, ckpt = (os.path.join(root, d) for d in ("landing", "table", "ckpt"))
    os.makedirs(landing)
    raw = tables.ledger_raw
    name = raw.select("source_name").orderBy("source_name").first().source_name
    part = raw.where(F.col("source_name") == name).drop("source_name")
    d = os.path.join(root, "tmp")
    part.coalesce(1).write.option("header", "true").csv(d)
    f = [x for x in os.listdir(d) if x.endswith(".csv")][0]
    os.replace(os.path.join(d, f), os.path.join(landing, name + ".csv"))
    q = start_ledger_ingest(spark, landing, table, LEDGER_FILE_SCHEMA, fmt="csv", checkpoint=ckpt)
    q.awaitTermination()
    out = spark.read.parquet(table)
    assert out.count() == part.count()
    assert [r.source_name for r in out.select("source_name").distinct().collect()] == [name]


def test_csv_ingest_goes_by_each_header(spark):
    root = tempfile.mkdtemp(prefix="dealbook-stream-csv-")
    landing, table, ckpt = (os.path.join(root, d) for d in ("landing", "table", "ckpt"))
    os.makedirs(landing)

    def land(name, text):
        with open(os.path.join(root, name), "w") as fh:
            fh.write(text)
        os.replace(os.path.join(root, name), os.path.join(landing, name))

    def run():
        start_ledger_ingest(spark, landing, table, "account string, category string, section int, monthly_balance_txt string",
                            fmt="csv", checkpoint=ckpt).awaitTermination()
        return sorted((r.account, r.category, r.month, str(r.quarantined) == "true") for r in spark.read.parquet(table).collect())

    land("A_MM011997_v1.xlsx.csv", "account,category,section,monthly_balance_txt\n6001,A1,1,2.5\n")
    land("B_MM021997_v1.xlsx.csv", "category,account\nA2,6002\n")
    want = [("6001", "A1", 1, False), ("6002", "A2", 2, False)]
    assert run() == want
    land("C_MM031997_v1.xlsx.csv", "section,account,category\nx,6003,A3\n")
    assert run() == want + [("6003", "A3", 3, True)]
    assert run() == want + [("6003", "A3", 3, True)]

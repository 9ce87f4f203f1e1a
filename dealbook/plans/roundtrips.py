"""Write-then-read pipelines over the source/sink layer.

Each function lands data the way an upstream system would (one file per
source file, paged JSON, a delimited export), reads it back with the
landing readers and applies the ETL transform, all as Spark jobs. The
written folders live under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import gzip

from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from dealbook.plans.etl import transform_categories, transform_ledger, transform_template
from dealbook.session import scratch_dir
from dealbook.sources.landing import (
    LAYOUTS, REJECT, adopt_files, adopted_folder, file_sized, land_ledger_files, read_json_pages, read_landed_csv,
    read_ledger_files, read_template_sheet, skipped_ledger_files,
)
from dealbook.sources.sinks import export_manifest, overwrite_table, read_delimited, read_table, stored, write_delimited
from dealbook.sources.versioned import exists, write_bytes

# Records per landed JSON page (the source API's page size).
PAGE_SIZE = 5000
LEDGER_FILE_SCHEMA = ("account string, account_name string, centre_name string, centre int, "
                      "section int, category string, monthly_balance_txt string")


def load_ledger_files(ledger_raw: DataFrame, company_names: dict[str, str] | None = None) -> DataFrame:
    """Land the ledger rows as CSV files, read the folder, transform (S3 + E1)."""
    spark = ledger_raw.sparkSession
    path = land_ledger_files(ledger_raw, scratch_dir(spark, "ledger-landing"))
    return transform_ledger(read_ledger_files(spark, path, "csv", schema=LEDGER_FILE_SCHEMA), company_names)


def landed_ledger_table(ledger_raw: DataFrame, company_names: dict[str, str] | None = None) -> DataFrame:
    """The reference's ledger flow: landed files -> E1 -> ledger table by year, read back."""
    path = scratch_dir(ledger_raw.sparkSession, "ledger-table")
    ledger = load_ledger_files(ledger_raw, company_names)
    overwrite_table(ledger, path, partition_by=["year"])
    return read_table(ledger_raw.sparkSession, path)


def accounted_load(spark: SparkSession, landing: str, table: str, schema: StructType | str = LEDGER_FILE_SCHEMA,
                   company_names: dict[str, str] | DataFrame | None = None, incoming: str | None = None) -> DataFrame:
    """Landing folder of CSV files -> ledger table, and what became of every row.

    One write stores good rows and rejects: the table is partitioned by
    ``quarantined`` and year, and a quarantined row keeps its text in
    ``_reject``. The counts are observed on that write. Returns one row:
    ``rows`` and ``rejects`` as observed, ``unparsed`` (good rows whose money
    is no number), ``money`` (its sum), ``stored`` (rows counted in the stored
    files) and ``skipped_files`` (files of ``incoming``, by default of the
    landing folder, without a readable row).
    """
    incoming = incoming or landing
    own = exists(spark, f"{landing}/{LAYOUTS}")
    landing = landing if own else adopted_folder(spark, landing)
    landed = read_landed_csv(spark, landing, schema)
    good = F.col(REJECT).isNull()
    ledger = transform_ledger(landed, company_names).withColumn("quarantined", ~good)
    seen = Observation("load")
    observed = ledger.observe(
        seen, F.count(F.when(good, 1)).alias("rows"), F.count(REJECT).alias("rejects"),
        F.count(F.when(good & F.col("monthly_balance").isNull(), 1)).alias("unparsed"),
        F.coalesce(F.sum(F.when(good, F.col("monthly_balance"))), F.lit(0)).cast("decimal(28,2)").alias("money"))
    with file_sized(spark):
        stored_rows = overwrite_table(observed, table, partition_by=["quarantined", "year"])
    told = seen.get
    skipped = skipped_ledger_files(spark, incoming, "csv", None if own else landing).count()
    return spark.createDataFrame(
        [(told["rows"], told["rejects"], told["unparsed"], float(told["money"]), stored_rows, skipped)],
        "rows long, rejects long, unparsed long, money double, stored long, skipped_files long")


def drifted_landing(ledger_raw: DataFrame) -> str:
    """The ledger rows as a folder of files from several upstream versions, one of them cut off.

    Names that end in .XLS come without ``centre`` and in another column
    order; in the others a section 7 is written as 'x7', which is no number.
    """
    spark = ledger_raw.sparkSession
    path = scratch_dir(spark, "incoming")
    old = F.col("source_name").endswith(".XLS")
    land_ledger_files(ledger_raw.where(old).select(
        "monthly_balance_txt", "section", "category", "source_name", "centre_name", "account_name", "account"), path)
    section = F.when(F.col("section") == 7, F.lit("x7")).otherwise(F.col("section").cast("string"))
    land_ledger_files(ledger_raw.where(~old).withColumn("section", section), path)
    write_bytes(spark, f"{path}/BalanceOmega_MM011997_v1.xlsx.csv.gz", gzip.compress(b"account,section\n1,2\n")[:12])
    return path


def load_drifted(ledger_raw: DataFrame) -> DataFrame:
    """``accounted_load`` of the drifted landing."""
    spark = ledger_raw.sparkSession
    landing = adopt_files(spark, incoming := drifted_landing(ledger_raw), scratch_dir(spark, "adopted"))
    return accounted_load(spark, landing, scratch_dir(spark, "ledger-table"), incoming=incoming)


def land_json_pages(records: DataFrame, page_size: int = PAGE_SIZE) -> str:
    """Write records as API-style pages ``{"@odata.id", "value": [...], "@odata.nextLink": ...}``.

    Every page but the last names the next one; pages are built in parallel
    from contiguous record numbers.
    """
    path = scratch_dir(records.sparkSession, "json-pages")
    numbered = _contiguous(records, "_record")
    pages = (numbered.withColumn("_page", F.floor(F.col("_record") / page_size))
             .withColumn("@odata.etag", F.concat(F.lit("W/"), F.col("_page").cast("string")))
             .groupBy("_page")
             .agg(F.collect_list(F.struct(*records.columns, F.col("`@odata.etag`"))).alias("value")))
    last = numbered.agg(F.floor(F.max("_record") / page_size).alias("last")).first()["last"]
    pages = (pages.withColumn("@odata.id", F.concat(F.lit("page-"), F.col("_page").cast("string")))
             .withColumn("@odata.nextLink", F.when(F.col("_page") < F.lit(last), F.concat(
                 F.lit("page-"), (F.col("_page") + 1).cast("string"))))
             .drop("_page"))
    pages.write.mode("overwrite").json(path)
    return path


def load_json_pages(category_raw: DataFrame) -> DataFrame:
    """Land category records as JSON pages, read and explode them, transform (S6 + E4)."""
    spark = category_raw.sparkSession
    path = land_json_pages(category_raw)
    records = read_json_pages(spark, path, "identifier string, name string, `@odata.etag` string", chained=True)
    return transform_categories(records)


def csv_roundtrip(df: DataFrame, schema: str, order_by: list[str] | None = None) -> DataFrame:
    """Ordered export with ';', header, empty NULLs and no quoting; read it back."""
    spark = df.sparkSession
    path = scratch_dir(spark, "export")
    write_delimited(df, path, order_by)
    return read_delimited(spark, path, schema)


def export_lines(export: DataFrame) -> DataFrame:
    """The statement export as a file: (line, text), header first, read back from its parts in order."""
    spark = export.sparkSession
    path = scratch_dir(spark, "statement-export")
    write_delimited(export, path)
    order = {p["part"]: i for i, p in enumerate(export_manifest(spark, path)["parts"])}
    place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    lines = spark.read.text(path).select(
        F.element_at(place, F.col("_metadata.file_name")).alias("part"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("text"))
    return lines.select((F.row_number().over(Window.orderBy("part", "block", "at")) - 1).alias("line"), "text")


def _contiguous(df: DataFrame, name: str) -> DataFrame:
    """Rows numbered from 0 without gaps; one count per partition goes to the driver."""
    rows = stored(df.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    table = df.sparkSession.createDataFrame(offsets, "_p long, _base long")
    return (rows.join(F.broadcast(table), part == F.col("_p")).withColumn(name, F.col("_base") + within)
            .drop("_at", "_p", "_base"))


def overwrite_count(df: DataFrame) -> DataFrame:
    """Create-or-replace a table and report the stored count."""
    spark = df.sparkSession
    path = scratch_dir(spark, "table")
    overwrite_table(df, path)
    return read_table(spark, path).agg(F.count(F.lit(1)).alias("rows"))


def materialise(df: DataFrame) -> DataFrame:
    """Write a result as Parquet and serve it from the files."""
    spark = df.sparkSession
    path = scratch_dir(spark, "summary")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load_template_sheet(template_raw: DataFrame) -> DataFrame:
    """Land the template as a delimited sheet with a header, read it, type it (S5 + E3)."""
    spark = template_raw.sparkSession
    path = scratch_dir(spark, "template")
    template_raw.write.mode("overwrite").option("header", "true").csv(path)
    return transform_template(read_template_sheet(spark, path))

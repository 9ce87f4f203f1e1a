"""Landing-folder readers: ledger files, template sheet, paged JSON records.

The reference downloads files one by one and concatenates them in memory.
Here the files are landed in a folder with a manifest of their headers and read
by Spark in one distributed scan; the file name becomes a column.
"""

from __future__ import annotations

import csv
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from dealbook.session import scratch_dir
from dealbook.sources.versioned import exists

# Landing extension added to the original file name (stripped again on read).
_LANDING_EXT = r"(?i)\.(csv|parquet|json|orc)$"


REJECT = "_reject"
#: Parquet manifest of a landing folder: the CSV header line of each layout folder.
LAYOUTS = "_layouts"
#: Lines of adopted files, and the header of each file.
LINES, HEADERS = "_lines", "_headers"
#: Shuffled bytes of a landed file or stored part; larger names are split, smaller ones share a task. Rows that repeat
#: names shrink about 15 times in a shuffle, so a task that sorts them holds a few hundred MB.
FILE_BYTES = 16 * 1024 * 1024
#: Bytes of the files that a task reads meanwhile: stored lines are packed as densely.
READ_BYTES = 32 * 1024 * 1024


def _decoded(path):
    """A path of the file metadata without its URL escapes."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _source_name():
    """Original file name of a landed file: its ``source_name=`` folder if there is one, else its own name."""
    folder = _decoded(F.regexp_extract(_decoded(F.col("_metadata.file_path")), r"/source_name=([^/]*)/", 1))
    name = F.when(folder != "", folder).otherwise(F.regexp_replace(
        F.regexp_replace(_decoded(F.col("_metadata.file_name")), r"(?i)\.(gz|bz2|zst)$", ""), _LANDING_EXT, ""))
    return F.when(name != "__HIVE_DEFAULT_PARTITION__", name)


@contextmanager
def file_sized(spark: SparkSession) -> Iterator[None]:
    """While it is open, rebalanced writes make parts of FILE_BYTES and tasks read READ_BYTES of files at most.

    The session's own settings come back after.
    """
    own = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": FILE_BYTES, "spark.sql.files.maxPartitionBytes": READ_BYTES}
    before = {key: spark.conf.get(key, None) for key in own}
    for key, size in own.items():
        spark.conf.set(key, str(size))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def land_ledger_files(ledger_raw: DataFrame, path: str, fmt: str = "csv") -> str:
    """One folder per original file name (``layout=.../source_name=...``), and a manifest of the layouts.

    Rows are rebalanced by name with sizes measured at run time: a name's rows
    come together, a name that holds a large share of the rows is split, and
    small names share a task. So there are about as many files as names and
    FILE_BYTES of data, however many tasks read the input. Names landed again
    replace their files.
    """
    spark = ledger_raw.sparkSession
    names = [c for c in ledger_raw.columns if c != "source_name"]
    header = ",".join(names)
    layout = f"{zlib.crc32(header.encode()):08x}"
    writer = (ledger_raw.hint("rebalance", "source_name").write.mode("overwrite")
              .option("partitionOverwriteMode", "dynamic").partitionBy("source_name"))
    with file_sized(spark):
        writer.option("header", "true").format(fmt).save(f"{path}/layout={layout}")
    spark.createDataFrame([(layout, header)], "layout string, header string").write.mode("append").parquet(
        f"{path}/{LAYOUTS}")
    return path


def adopt_files(spark: SparkSession, incoming: str, path: str) -> str:
    """Takes over CSV files from anywhere below ``incoming``: lines and headers are stored in ``path``.

    One pass reads the texts (unreadable files are skipped) and stores their
    lines, rebalanced by file. A file's header is the first line of its first
    block; the manifest of headers is made from the stored lines of first
    blocks and stored beside them.
    """
    lines = (spark.read.option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").text(incoming)
             .select(*line_columns()))
    return adopt_lines(lines, path)


def line_columns() -> list:
    """What ``adopt_lines`` needs of a text source."""
    return [_source_name().alias("source_name"), _decoded(F.col("_metadata.file_path")).alias("file"),
            F.col("_metadata.file_block_start").alias("block"), "value"]


def adopt_lines(lines: DataFrame, path: str) -> str:
    """Stores lines of CSV files (``line_columns``, in the order of the files) and the headers of the files."""
    spark = lines.sparkSession
    lines = lines.withColumn("at", F.monotonically_increasing_id())
    with file_sized(spark):
        lines.hint("rebalance", "file").write.mode("overwrite").parquet(f"{path}/{LINES}")
    heads = (spark.read.parquet(f"{path}/{LINES}").where("block = 0").groupBy("file")
             .agg(F.min("at").alias("header_at"), F.min_by("value", "at").alias("header")))
    heads.withColumn("header", F.regexp_replace("header", "^\ufeff", "")).write.mode("overwrite").parquet(
        f"{path}/{HEADERS}")
    return path


def _typed(df: DataFrame, names: list[str], schema: StructType) -> DataFrame:
    """Text columns of one layout (``names``, ``source_name``, ``REJECT``) as the wanted columns.

    A wanted column that the layout lacks is NULL, other columns are dropped,
    and a value that does not fit its type leaves the row's text in ``REJECT``.
    """
    cells, bad = [], F.lit(False)
    for f in schema.fields:
        if f.name == "source_name":
            continue
        if f.name in names:
            value = F.col(f"`{f.name}`")
            cells.append(value.try_cast(f.dataType).alias(f.name))
            bad = bad | (value.isNotNull() & value.try_cast(f.dataType).isNull())
        else:
            cells.append(F.lit(None).cast(f.dataType).alias(f.name))
    text = F.coalesce(F.col(REJECT), F.when(bad, F.to_csv(F.struct(*[F.col(f"`{n}`") for n in names]))))
    return df.select(*cells, "source_name", text.alias(REJECT))


def _header_names(header: str) -> list[str]:
    """Column names of a header line; a repeated name gets its place behind it, so the first one counts."""
    names = next(csv.reader([header]), [])
    return [n if n not in names[:i] else f"{n}#{i}" for i, n in enumerate(names)]


def _layout_schema(names: list[str]) -> StructType:
    return StructType([StructField(n, StringType()) for n in names] + [StructField(REJECT, StringType())])


def _empty(spark: SparkSession, schema: StructType) -> DataFrame:
    fields = [*[f for f in schema.fields if f.name != "source_name"], StructField("source_name", StringType()),
              StructField(REJECT, StringType())]
    return spark.createDataFrame([], StructType(fields))


def _landed_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV folders of ``land_ledger_files``, one read per layout of the manifest."""
    out = None
    for row in spark.read.parquet(f"{path}/{LAYOUTS}").distinct().orderBy("layout").collect():
        names = _header_names(row["header"])
        df = (spark.read.schema(StructType([*_layout_schema(names).fields, StructField("source_name", StringType())]))
              .option("header", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", REJECT)
              .option("ignoreCorruptFiles", "true").csv(f"{path}/layout={row['layout']}"))
        part = _typed(df, names, schema)
        out = part if out is None else out.unionByName(part)
    return _empty(spark, schema) if out is None else out


def _adopted_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Lines of ``adopt_files``, parsed by the header of their file; one parse per distinct header."""
    heads = spark.read.parquet(f"{path}/{HEADERS}")
    lines = spark.read.parquet(f"{path}/{LINES}").join(heads, "file").where("block <> 0 or at <> header_at")
    out = None
    for row in heads.select("header").distinct().orderBy("header").collect():
        names = _header_names(row["header"])
        ddl = ", ".join("`" + n.replace("`", "``") + "` STRING" for n in [*names, REJECT])
        cells = F.from_csv("value", ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECT})
        own = lines.where(F.col("header") == row["header"]).where("value <> ''")
        part = _typed(own.select(cells.alias("c"), "source_name").select("c.*", "source_name"), names, schema)
        out = part if out is None else out.unionByName(part)
    return _empty(spark, schema) if out is None else out


def adopted_folder(spark: SparkSession, path: str) -> str:
    """``path`` if it holds adopted lines, else a new folder that takes over the CSV files below it."""
    return path if exists(spark, f"{path}/{HEADERS}") else adopt_files(spark, path, scratch_dir(spark, "adopted"))


def read_landed_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All rows of a landing folder with ``source_name`` and, for rows that do not fit, their text in ``REJECT``.

    CSV files may differ in the order and number of their columns; each goes
    by its own header, from the folder's manifest. A folder without one is
    adopted first. A row that does not fit its header or a value that does not
    fit its type is a reject.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if exists(spark, f"{path}/{LAYOUTS}"):
        return _landed_csv(spark, path, schema)
    return _adopted_csv(spark, adopted_folder(spark, path), schema)


def read_ledger_files(spark: SparkSession, path: str, fmt: str = "parquet",
                      schema: StructType | str | None = None) -> DataFrame:
    """All ledger files under ``path`` with a ``source_name`` column.

    * Columns are aligned by name across files (Parquet/ORC ``mergeSchema``,
      CSV by each file's own header, see ``read_landed_csv``; CSV needs
      ``schema``). A column missing from a file is NULL for its rows (U1).
    * Unreadable files are skipped (``ignoreCorruptFiles``) and malformed CSV
      rows left out (S4); ``rejected_ledger_rows`` and ``skipped_ledger_files``
      report both.
    * ``source_name`` is the original file name: a ``source_name=...``
      partition directory if present, else the data file's name without the
      landing extension.
    """
    if fmt == "csv":
        return read_landed_csv(spark, path, schema).where(F.col(REJECT).isNull()).drop(REJECT)
    reader = spark.read.option("ignoreCorruptFiles", "true").option("mergeSchema", "true")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.format(fmt).load(path)
    if "source_name" not in df.columns:
        df = df.withColumn("source_name", F.regexp_replace(F.col("_metadata.file_name"), _LANDING_EXT, ""))
    return df


def rejected_ledger_rows(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of landed CSV files that do not fit, with their file: (source_name, row)."""
    return (read_landed_csv(spark, path, schema).where(F.col(REJECT).isNotNull())
            .select("source_name", F.col(REJECT).alias("row")))


def skipped_ledger_files(spark: SparkSession, path: str, fmt: str = "parquet",
                         adopted: str | None = None) -> DataFrame:
    """Files under ``path`` that hold bytes but gave no row (unreadable): (file_path, bytes).

    Only the listing of ``path`` is read where ``adopted`` names the folder into which ``adopt_files`` took its lines.
    """
    every = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select(_decoded(F.col("path")).alias("file_path"), F.col("length").alias("bytes")))
    if adopted:
        read = spark.read.parquet(f"{adopted}/{LINES}").select(F.col("file").alias("file_path"))
    else:
        read = (spark.read.option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true")
                .format("text" if fmt == "csv" else fmt).load(path)
                .select(_decoded(F.col("_metadata.file_path")).alias("file_path")))
    return every.join(read.distinct(), "file_path", "left_anti")


def read_template_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Template exported as delimited text with a header row; every column text."""
    schema = "n string, concept string, category string, parent string, ratio string"
    return spark.read.option("header", "true").schema(schema).csv(path)


def check_page_chain(pages: DataFrame) -> None:
    """Raises unless (page, next) rows are one chain: every page once, every link resolved, one first page.

    Links are joined to pages, so the check is a few shuffles of page names
    whatever their number; the message names a page.
    """
    def one(df: DataFrame, column: str):
        row = df.select(column).limit(1).collect()
        return row[0][0] if row else None

    links = pages.where(F.col("next").isNotNull()).select("next")
    twice = one(pages.groupBy("page").count().where("count > 1"), "page")
    if twice is not None:
        raise ValueError(f"the page {twice} is there more than once")
    again = one(links.groupBy("next").count().where("count > 1"), "next")
    if again is not None:
        raise ValueError(f"more than one page links to {again}")
    missing = one(links.join(pages, links["next"] == pages["page"], "left_anti"), "next")
    if missing is not None:
        raise ValueError(f"the page {missing} is missing")
    first = [r["page"] for r in pages.join(links.select(F.col("next").alias("to")), F.col("page") == F.col("to"),
                                           "left_anti").select("page").orderBy("page").limit(2).collect()]
    if len(first) > 1 or not first and pages.limit(1).count():
        raise ValueError(f"no page links to {first[1]}, so pages before it are missing" if first
                         else "every page is linked: the chain has no first page")


def read_json_pages(spark: SparkSession, path: str, record_schema: StructType | str,
                    multiline: bool = False, chained: bool = False) -> DataFrame:
    """Records of paged API responses ``{"value": [...], "@odata.nextLink": ...}``.

    Each page is one JSON document; the ``value`` arrays of all pages are
    exploded into rows in one distributed read. Metadata fields (names
    starting with '@') are dropped (P3). With ``chained`` the next-page links
    are followed first: a missing or repeated page raises and is named. A page
    goes by its ``@odata.id``, or by its file name (without extension) if it
    has none; a link may be a whole address that ends in that name.
    """
    if isinstance(record_schema, str):
        record_schema = StructType.fromDDL(record_schema)
    page_schema = (StructType().add("value", ArrayType(record_schema)).add("@odata.id", StringType())
                   .add("@odata.nextLink", StringType()))
    pages = spark.read.option("multiLine", str(multiline).lower()).schema(page_schema).json(path)
    if chained:
        own = F.coalesce(F.col("`@odata.id`"), F.regexp_replace(_decoded(F.col("_metadata.file_name")), r"\.[^.]*$", ""))
        check_page_chain(pages.select(own.alias("page"), F.regexp_extract(
            "`@odata.nextLink`", r"([^/]*)$", 1).alias("next")))
    records = pages.select(F.explode("value").alias("r")).select("r.*")
    return records.drop(*[c for c in records.columns if c.startswith("@")])

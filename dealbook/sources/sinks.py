"""Writers: table overwrite with count, delimited export, statement layout, JSON-safe values."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, FloatType, MapType, StructType

from dealbook.functions.text import MONTH_NAMES_TITLE
from dealbook.session import scratch_dir
from dealbook.sources.versioned import (  # noqa: F401 - the reader belongs to the sink
    names_in, read_bytes, read_table, replace_table, size_of, write_bytes,
)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def overwrite_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                    replace_partitions_only: bool = False) -> int:
    """Create-or-replace a table and return its row count (S8, S9); ``read_table`` reads it.

    The new version is written aside and becomes current by one commit, so a
    replace that fails leaves the old table. The count is read back from the
    written files, so it is the count of what was stored, without a second
    pass over the input. With ``partition_by`` (e.g. the ledger by year) and
    ``replace_partitions_only``, only the partitions present in ``df`` are
    replaced (a monthly reload rewrites its year, not the whole table).
    """
    return replace_table(df, path, partition_by, replace_partitions_only)


#: First part of an export: its header line, and a manifest of the parts in order.
HEADER_PART, MANIFEST = "part--header.txt", "_manifest.json"


def plain_text(value, kind) -> Column:
    """A field's text in an export: numbers without needless digits or exponents, NULL and NaN as an empty text."""
    text = value.cast("string")
    if isinstance(kind, (DoubleType, FloatType)):
        # The shortest digits that give the number back, written out; beyond 10^16 whole numbers only.
        digits = F.when(F.abs(value) < 1e16, text.try_cast("decimal(38,22)").cast("string")).otherwise(
            value.try_cast("decimal(38,0)").cast("string"))
        text = F.when(~F.isnan(value), F.coalesce(digits, text))
    if isinstance(kind, (DoubleType, FloatType, DecimalType)):
        text = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
        text = F.when(text == "-0", "0").otherwise(text)
    return F.coalesce(text, F.lit(""))


def write_delimited(df: DataFrame, path: str, order_by: list[Column | str] | None = None, sep: str = ";") -> None:
    """One delimited text in numbered parts: header first, ';' separator, NULL as empty, no quoting.

    Each line is the plain join of the field texts, so a field containing the
    separator is written as is (the export format has no quoting). Rows are
    range-partitioned by ``order_by`` and sorted within parts (a frame that is
    sorted already needs none), so the parts in their order are the whole text
    in order, however large. The header is a
    part of its own before the others, and the manifest lists every part with
    its bytes and its offset in the joined text, whose last line has no end.
    ``path`` must be new.
    """
    spark = df.sparkSession
    line = F.concat_ws(sep, *[plain_text(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields])
    if order_by:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    df.select(line.alias("value")).write.text(path)
    write_bytes(spark, f"{path}/{HEADER_PART}", (sep.join(df.columns) + "\n").encode())
    found = [(HEADER_PART, -1)] + [(n, int(n.split("-")[1])) for n in names_in(spark, path) if re.match(r"part-\d", n)]
    parts, offset = [], 0
    for name, _ in sorted(found, key=lambda x: x[1]):
        size = size_of(spark, f"{path}/{name}")
        if size:
            parts.append({"part": name, "offset": offset, "bytes": size})
        offset += size
    parts[-1]["bytes"] -= 1  # the text ends with its last line, not after it
    write_bytes(spark, f"{path}/{MANIFEST}", json.dumps({"bytes": offset - 1, "parts": parts}).encode())


def export_manifest(spark: SparkSession, path: str) -> dict:
    """Parts of an export in order: ``{"bytes": ..., "parts": [{"part", "offset", "bytes"}, ...]}``."""
    return json.loads(read_bytes(spark, f"{path}/{MANIFEST}"))


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ";") -> DataFrame:
    """Rows of a folder written by ``write_delimited``, read back by position."""
    return (spark.read.option("sep", sep).option("quote", "").option("pathGlobFilter", "part-[0-9]*").schema(schema)
            .csv(path))


def _without_nan(value, kind):
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(~F.isnan(value), value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _without_nan(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: _without_nan(x, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[
            _without_nan(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    return value


def nan_to_null(df: DataFrame) -> DataFrame:
    """Float NaN -> NULL in every floating value, nested ones included (S12), for JSON output."""
    return df.select(*[_without_nan(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def to_json_records(df: DataFrame) -> DataFrame:
    """One JSON text per row with NaN already NULL."""
    return nan_to_null(df).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json"))


def statement_export(wide: DataFrame, periods: list[str]) -> DataFrame:
    """Flat export layout: 'Categoría', 'Concepto', then '{Month} Resultado' and
    '{Month} %' per period, 'Total' last (S11, R12). ``periods`` are those with
    data, so every value is there; missing percentages stay empty. The frame is
    in template order; ``write_delimited`` makes it a file."""
    cols = [F.col("category").alias("Categoría"), F.col("concept").alias("Concepto")]
    for p in periods:
        label = MONTH_NAMES_TITLE[int(p) - 1] if p.isdigit() and 1 <= int(p) <= 12 else p
        cols.append(F.col(f"res_{p}").alias(f"{label} Resultado"))
        cols.append(F.col(f"pct_{p}").alias(f"{label} %"))
    return wide.orderBy("n").select(*cols)

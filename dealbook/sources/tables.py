"""Session catalog and ordered template read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def register_views(spark: SparkSession, tables: dict[str, DataFrame]) -> list[str]:
    """Register DataFrames as temp views for SQL use; returns the names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return sorted(tables)


def list_tables(spark: SparkSession) -> DataFrame:
    """Tables and views visible to SQL, as a DataFrame."""
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, table_type string, is_temporary boolean")


def ordered_template(template: DataFrame) -> DataFrame:
    """Template in statement order ``n`` (S2, O6); NULL ``n`` last."""
    return template.orderBy(F.col("n").asc_nulls_last(), F.col("category").asc_nulls_last())

"""Joins that spread rows without a key, and co-bucketed tables that join without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def spread_key(key: Column, spread: list[Column]) -> Column:
    """The key as text; a NULL key becomes a text of its own that no key can equal, by the hash of ``spread``.

    A NULL key matches nothing, yet a shuffle join would send all such rows to
    one task. With the hash of an id in its place they go everywhere.
    """
    return F.coalesce(F.concat(F.lit("k"), key.cast("string")),
                      F.concat(F.lit("-"), F.xxhash64(*spread).cast("string")))


SPREAD_KEY = "_spread_key"


def keyed(right: DataFrame, key: str) -> DataFrame:
    """Rows of ``right`` with a key, under the text that ``spread_key`` gives it (column ``SPREAD_KEY``)."""
    return right.where(F.col(key).isNotNull()).withColumn(SPREAD_KEY, F.concat(F.lit("k"), F.col(key).cast("string")))


def left_join_spread(left: DataFrame, right: DataFrame, key: str, spread: list[str]) -> DataFrame:
    """``left LEFT JOIN right USING (key)`` in one pass over ``left``; rows of NULL key are dealt by ``spread``.

    ``right`` comes from ``keyed`` (aggregated by ``SPREAD_KEY`` or not); its NULL keys match nothing.
    """
    at = left.withColumn(SPREAD_KEY, spread_key(F.col(key), [F.col(c) for c in spread]))
    return at.join(right.drop(key), SPREAD_KEY, "left").drop(SPREAD_KEY)


#: Rows that a bucket holds about, and rows of one key from which on it is cut into pieces of about so many.
BUCKET_ROWS, PIECE_ROWS = 500_000, 62_500
#: Pieces of a frequent key.
PIECES = "_pieces"


def frequent_keys(df: DataFrame, key: str, piece_rows: int = PIECE_ROWS) -> tuple[int, DataFrame | None]:
    """Rows of ``df``, and its keys of more than ``piece_rows`` rows with their number of pieces (none: None).

    There are fewer such keys than rows / ``piece_rows``; they alone reach the driver.
    """
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    rows, found = per_key.agg(F.sum("n"), F.collect_list(F.when(
        F.col(key).isNotNull() & (F.col("n") > piece_rows), F.struct(key, "n")))).first()
    if not found:
        return rows or 0, None
    kind = df.schema[key].dataType.simpleString()
    return rows, df.sparkSession.createDataFrame([(r[key], -(-r["n"] // piece_rows)) for r in found],
                                                 f"`{key}` {kind}, {PIECES} int")


def _piece(key: Column, at: Column) -> Column:
    return F.concat(F.lit("h"), at.cast("string"), F.lit(":"), key.cast("string"))


def dealt_by_key(df: DataFrame, key: str, spread: list[str], frequent: DataFrame | None) -> DataFrame:
    """``df`` with its spread key as ``{key}_bucket``; rows of a frequent key are dealt over its pieces by ``spread``."""
    plain, hashed = spread_key(F.col(key), [F.col(c) for c in spread]), F.xxhash64(*[F.col(c) for c in spread])
    if frequent is None:
        return df.withColumn(f"{key}_bucket", plain)
    return (df.join(F.broadcast(frequent), key, "left")
            .withColumn(f"{key}_bucket", F.when(F.col(PIECES).isNotNull(), _piece(F.col(key), F.pmod(hashed, PIECES)))
                        .otherwise(plain)).select(*df.columns, f"{key}_bucket"))


def repeated_by_key(df: DataFrame, key: str, frequent: DataFrame | None) -> DataFrame:
    """``df`` with its key as ``{key}_bucket``; a row of a frequent key is there once for each of its pieces."""
    plain = spread_key(F.col(key), [F.col(key)])
    if frequent is None:
        return df.withColumn(f"{key}_bucket", plain)
    pieces = F.transform(F.sequence(F.lit(0), F.col(PIECES) - 1), lambda i: _piece(F.col(key), i))
    return (df.join(F.broadcast(frequent), key, "left")
            .withColumn(f"{key}_bucket", F.explode(F.when(F.col(PIECES).isNotNull(), pieces).otherwise(F.array(plain))))
            .select(*df.columns, f"{key}_bucket"))


def write_bucketed(df: DataFrame, table: str, column: str, buckets: int, path: str) -> DataFrame:
    """``df`` stored in ``buckets`` sorted buckets of ``column``, read back as a table.

    Tables with one number of buckets join on that column, and group by it,
    without a shuffle. ``path`` is a folder that driver and executors share.
    """
    spark: SparkSession = df.sparkSession
    (df.repartition(buckets, F.col(column))  # one file a bucket
     .write.mode("overwrite").option("path", path).format("parquet")
     .bucketBy(buckets, column).sortBy(column).saveAsTable(table))
    return spark.table(table)

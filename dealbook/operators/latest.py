"""Latest row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def latest_value(df: DataFrame, key: str, order_col: str, alias: str | None = None) -> DataFrame:
    """``ROW_NUMBER() OVER (PARTITION BY key ORDER BY order_col DESC) = 1`` when only
    the ordering column is needed: ``max`` per key (NULLs sort last, so a key
    whose values are all NULL keeps NULL).

    A grouped ``max`` is combined map-side before the shuffle, so a key that
    holds a third of the rows costs one row per task; a window would move
    every row of that key into one task.
    """
    return df.groupBy(key).agg(F.max(order_col).alias(alias or order_col))


def latest_row(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """Whole latest row per key via ``max_by`` (partial aggregation, no window)."""
    others = [c for c in df.columns if c != key]
    packed = F.struct(*[F.col(c) for c in others])
    # Rows with a NULL ordering value lose against any non-NULL one.
    rank = F.struct(F.col(order_col).isNotNull(), F.col(order_col))
    return (df.groupBy(key).agg(F.max_by(packed, rank).alias("_row"))
            .select(key, *[F.col(f"_row.{c}").alias(c) for c in others]))

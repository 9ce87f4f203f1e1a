"""Totals rows and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def append_total_row(df: DataFrame, label_col: str, label: str,
                     aggregates: dict[str, Column], flag_col: str | None = "is_total") -> DataFrame:
    """``df`` plus one totals row computed by ``aggregates`` over all of ``df``.

    One aggregation with grouping sets ``(_row)`` and ``()``: every input row
    is its own group (returned unchanged) and the empty set gives the totals
    row, so ``df`` is evaluated once instead of once per branch of a union.
    Body groups hold one row, so ``max`` returns it (an order-insensitive
    aggregate, which lets Spark drop any sort below). Columns without an
    aggregate are NULL in the totals row. ``flag_col``
    marks the totals row so later steps can exclude it (U4).
    """
    keyed = df.withColumn("_row", F.monotonically_increasing_id())
    is_total = F.grouping("_row") == 1
    cols = []
    for c in df.columns:
        field = df.schema[c]
        if c == label_col:
            value = F.when(is_total, F.lit(label)).otherwise(F.max(F.col(f"`{c}`")))
        elif c in aggregates:
            value = F.when(is_total, aggregates[c]).otherwise(F.max(F.col(f"`{c}`")))
        else:
            value = F.when(~is_total, F.max(F.col(f"`{c}`")))
        cols.append(value.cast(field.dataType).alias(c))
    if flag_col:
        cols.append(is_total.alias(flag_col))
    return keyed.groupingSets([["_row"], []], "_row").agg(*cols).drop("_row")

"""Pivot with explicit columns and a row total."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def distinct_values(df: DataFrame, col: str, max_values: int = 1000) -> list:
    """Sorted distinct values of a low-cardinality column, for pivot headers.

    Headers become columns, so their number must be bounded; more than
    ``max_values`` is an error instead of an unbounded collect.
    """
    rows = df.select(col).distinct().limit(max_values + 1).collect()
    if len(rows) > max_values:
        raise ValueError(f"{col} has more than {max_values} distinct values; cannot pivot")
    return sorted(r[0] for r in rows if r[0] is not None)


def pivot_sum(df: DataFrame, row_key: str, pivot_col: str, value_col: str,
              values: list, total_col: str | None = None) -> DataFrame:
    """``groupBy(row_key).pivot(pivot_col, values).sum(value_col)``, missing cells 0,
    plus an optional row-total column over all pivot values."""
    aggs = [F.sum(F.when(F.col(pivot_col) == F.lit(v), F.col(value_col))).alias(str(v)) for v in values]
    if total_col:
        aggs.append(F.sum(F.when(F.col(pivot_col).isin(*values), F.col(value_col))).alias(total_col))
    out = df.groupBy(row_key).agg(*aggs)
    return out.na.fill(0, subset=[str(v) for v in values] + ([total_col] if total_col else []))

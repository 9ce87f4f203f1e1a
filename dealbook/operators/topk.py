"""Top-k by a measure with a deterministic tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def top_k(df: DataFrame, by: Column, k: int, tie_break: list[Column]) -> DataFrame:
    """First ``k`` rows by ``by`` descending, ties broken by ``tie_break``.

    ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject: each task keeps
    its own top k, only k rows per task reach the final merge.
    """
    return df.orderBy(by.desc_nulls_last(), *tie_break).limit(k)

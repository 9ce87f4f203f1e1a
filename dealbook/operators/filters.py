"""Predicates: active orders, optional period filters, sentinel-aware filter lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# A filter argument equal to one of these means "no filter".
NO_FILTER_SENTINELS = ("", "Todas", "Todos")


def unset(value) -> bool:
    """True for None and the 'all' sentinels of the reference."""
    return value is None or (isinstance(value, str) and value.strip() in NO_FILTER_SENTINELS)


def all_of(conditions: list[Column]) -> Column:
    """AND of a list of conditions; the empty list is TRUE."""
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def period(date_col: Column | str, year=None, month=None) -> Column:
    """Optional year/month filter on a date column.

    Only the given parts become predicates, so with neither given the result
    is TRUE (rows with a NULL date included), exactly like
    ``(? IS NULL OR YEAR(d) = ?) AND (? IS NULL OR MONTH(d) = ?)``.
    """
    d = F.col(date_col) if isinstance(date_col, str) else date_col
    conds = []
    if not unset(year):
        conds.append(F.year(d) == F.lit(int(year)))
    if not unset(month):
        conds.append(F.month(d) == F.lit(int(month)))
    return all_of(conds)


def active_orders(orders: DataFrame) -> DataFrame:
    """Active orders: state 0 and an order number."""
    return orders.where((F.col("state_code") == 0) & F.col("order_no").isNotNull())


def equals_unless_unset(column: str, value, cast: str | None = None) -> list[Column]:
    """[col = value] unless the value is a sentinel (P9). Values are bound as
    literals, never interpolated into SQL text."""
    if unset(value):
        return []
    v = F.lit(value)
    if cast:
        v = v.cast(cast)
    return [F.col(column) == v]

"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_away(x: Column | str, digits: int = 2) -> Column:
    """ROUND(double, n) as a columnar engine does it: round(x * 10^n) / 10^n.

    Spark's ``round(x, n)`` rounds the decimal text of the double, which differs
    on binary ties (e.g. 1.005); scaling first gives the usual engine result.
    """
    scale = float(10 ** digits)
    return F.round(_col(x).cast("double") * F.lit(scale), 0) / F.lit(scale)


def safe_pct(value: Column | str, denominator: Column | str) -> Column:
    """value / denominator * 100, NULL when the denominator is 0."""
    v, d = _col(value).cast("double"), _col(denominator).cast("double")
    return F.when(d != 0, v / d * F.lit(100.0))


def variance_pct(diff: Column | str, base: Column | str) -> Column:
    """diff / |base| * 100, NULL when the base is 0 (F8)."""
    b = _col(base).cast("double")
    return F.when(b != 0, _col(diff).cast("double") / F.abs(b) * F.lit(100.0))


def share_pct(count: Column | str, total: Column | str) -> Column:
    """count * 100 / total as a double."""
    return _col(count).cast("double") * F.lit(100.0) / _col(total).cast("double")


def try_number(text: Column | str, to: str = "double") -> Column:
    """Lenient numeric parse: anything unparsable becomes NULL."""
    return F.trim(_col(text).cast("string")).try_cast(to)


def to_int(x: Column | str) -> Column:
    """Integer coercion that keeps NULL."""
    return _col(x).try_cast("int")

"""Display formatting at the report edge."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from dealbook.functions.text import MONTH_NAMES_TITLE


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def accounting(x: Column | str) -> Column:
    """Integer with '.' thousands, negatives in parentheses, NULL -> '' (F24).

    Rounding to the integer is half-even, like the reference's formatter.
    """
    v = F.bround(_col(x).cast("double"), 0)
    digits = F.translate(F.format_number(F.abs(v), 0), ",", ".")
    return (F.when(v.isNull(), F.lit(""))
            .when(v < 0, F.concat(F.lit("("), digits, F.lit(")")))
            .otherwise(digits))


def percent_text(x: Column | str) -> Column:
    """'12.34 %' with two decimals, NULL or NaN -> '' (F25)."""
    v = _col(x).cast("double")
    # format_number rounds half-even on the exact binary value (like the
    # reference's formatter); its thousands commas are removed.
    text = F.translate(F.format_number(v, 2), ",", "")
    return F.when(v.isNull() | F.isnan(v), F.lit("")).otherwise(F.concat(text, F.lit(" %")))


def month_label(month: Column | str) -> Column:
    """Capitalised month name for 1-12; other values as text, e.g. 'Total' (F26)."""
    m = _col(month).cast("string")
    as_int = m.try_cast("int")
    names = F.array(*[F.lit(x) for x in MONTH_NAMES_TITLE])
    return F.when(as_int.between(1, 12), F.element_at(names, as_int)).otherwise(m)


def sign_class(x: Column | str) -> Column:
    """'pos', 'neg' or 'zero' by the sign of the value; NULL stays NULL."""
    v = _col(x)
    return F.when(v > 0, "pos").when(v < 0, "neg").when(v == 0, "zero")

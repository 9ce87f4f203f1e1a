"""Date parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# A date text must start with a year of one to four digits, a month and a day, separated by
# '-' or '/', optionally followed by a time part. This is the shape both
# engines read the same way; texts such as '2024' (a bare year, which Spark
# would read as 1 January) or '15/01/2024' give NULL.
_DATE_SHAPE = r"^\s*(\d{1,4})[-/](\d{1,2})[-/](\d{1,2})(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d*)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?)?\s*$"


def try_date(text: Column | str) -> Column:
    """TRY_CAST(text AS DATE) with the shape guard: NULL instead of an error.

    One regular expression both checks the shape and cuts the date part
    (the time part of 'YYYY-MM-DDThh:mm:ssZ' or 'YYYY-MM-DD hh:mm:ss' is
    dropped); a non-matching text extracts '' which parses to NULL.
    """
    c = F.col(text) if isinstance(text, str) else text
    date_part = F.regexp_replace(F.regexp_extract(c, _DATE_SHAPE, 0), _DATE_SHAPE, "000$1-$2-$3")
    # Years of fewer than four digits get their zeros.
    date_part = F.regexp_replace(date_part, r"^0+(\d{4}-)", "$1")
    # Spark's own string->date cast (no formatter, no exceptions) on the cut text.
    return date_part.try_cast("date")


def first_of_month(year: Column, month: Column) -> Column:
    """First day of (year, month); any invalid or NULL part gives NULL."""
    text = F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lit("01"))
    return F.when(year.isNotNull() & month.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))

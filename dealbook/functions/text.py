"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values that must equal the reference's for right results:
# month names used by the budget month text.
MONTH_NAMES_TITLE = ["Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio",
                     "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre"]
# Upper-case month names written by the ledger load.
MONTH_NAMES_UPPER = [m.upper() for m in MONTH_NAMES_TITLE]
# Code pattern of a percentage denominator: an upper-case letter, then letters
# or digits, ending in a digit, as a whole word.
RATIO_CODE_PATTERN = r"\b([A-Z][A-Z0-9]*\d+)\b"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio_codes(ratio: Column | str) -> Column:
    """Denominator codes of a ratio text such as 'T12/A7+A8' -> ['A7', 'A8'].

    The text is split at the first '/'; codes are taken from the right side
    only. No '/' or NULL gives an empty array. Duplicates are kept.
    """
    r = _col(ratio)
    pos = F.instr(r, "/")
    right = F.when(pos > 0, r.substr(pos + 1, F.length(r)))
    codes = F.regexp_extract_all(right, F.lit(RATIO_CODE_PATTERN), 1)
    return F.coalesce(codes, F.array().cast("array<string>"))


def starts_with_total(category: Column | str) -> Column:
    """A template code starting with 'T' is a total line; NULL is not."""
    return F.coalesce(_col(category).startswith("T"), F.lit(False))


def file_name_parts(name: Column | str) -> Column:
    """Extension stripped (case-insensitive .xls/.xlsx), split on '_' into at most 3 parts."""
    stem = F.regexp_replace(_col(name), r"(?i)\.xlsx?$", "")
    return F.split(stem, "_", 3)


def text_right(text: Column | str, n: int) -> Column:
    """Last n characters; shorter texts are returned whole."""
    t = _col(text)
    return F.when(F.length(t) <= n, t).otherwise(F.substring(t, -n, n))


def zero_pad(x: Column | str, width: int = 2) -> Column:
    """Left zero padding of the text form."""
    return F.lpad(_col(x).cast("string"), width, "0")


def composite_key(*cols: Column | str) -> Column:
    """'account-centre-section' with NULL parts written as empty text."""
    return F.concat_ws("-", *[F.coalesce(_col(c).cast("string"), F.lit("")) for c in cols])


def label_concat(first: Column | str, second: Column | str) -> Column:
    """trim(first + ' ' + second), NULL parts as empty text."""
    return F.trim(F.concat(F.coalesce(_col(first), F.lit("")), F.lit(" "),
                           F.coalesce(_col(second), F.lit(""))))


def month_text(month: Column | str) -> Column:
    """Budget month text: 'Total' for accumulations, a month name for 1-12,
    otherwise the text unchanged (F19)."""
    m = _col(month).cast("string")
    key = F.upper(F.trim(m))
    as_int = key.try_cast("int")
    names = F.array(*[F.lit(x) for x in MONTH_NAMES_TITLE])
    return (F.when(key.isin("ACUMULADO", "TOTAL"), F.lit("Total"))
            .when(as_int.between(1, 12), F.element_at(names, as_int))
            .otherwise(F.trim(m)))

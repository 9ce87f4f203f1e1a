"""ETL transforms: ledger files, budget records, template sheet, categories.

Each transform is a pure DataFrame -> DataFrame function; readers for the
landed files are in ``dealbook.sources.landing`` and writers in
``dealbook.sources.sinks``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dealbook.functions import (
    composite_key, file_name_parts, first_of_month, label_concat, month_text,
    text_right, to_int, try_number,
)
from dealbook.functions.text import MONTH_NAMES_UPPER

# Fixed value: ledger rows without a category are filed under this code.
NO_CATEGORY = "without_category"


def map_codes(df: DataFrame, code: str, target: str, mapping: dict[str, str] | DataFrame | None) -> DataFrame:
    """``target`` = the name of ``code`` by a mapping; unknown codes map to themselves.

    A mapping is a dict (a literal map, for a handful of names) or a DataFrame
    ``(code, name)`` of any size. That is joined, broadcast or not by its
    measured size, and its codes are checked: one that occurs with more than
    one row raises. Rows of the mapping without a code or a name are ignored.
    """
    if mapping is None or isinstance(mapping, dict) and not mapping:
        return df.withColumn(target, F.col(code))
    if isinstance(mapping, dict):
        pairs = [F.lit(x) for pair in sorted(mapping.items()) for x in pair]
        return df.withColumn(target, F.coalesce(F.element_at(F.create_map(*pairs), F.col(code)), F.col(code)))
    names = mapping.select(F.col(mapping.columns[0]).cast("string").alias("_code"),
                           F.col(mapping.columns[1]).cast("string").alias("_name")).where(
        "_code is not null and _name is not null")
    twice = names.groupBy("_code").count().where("count > 1").select("_code").limit(1).collect()
    if twice:
        raise ValueError(f"the mapping names the code {twice[0]['_code']} more than once")
    return (df.join(names, F.col(code) == F.col("_code"), "left")
            .withColumn(target, F.coalesce("_name", code)).drop("_code", "_name"))


def transform_ledger(raw: DataFrame, company_names: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """Ledger file rows -> ledger table.

    ``source_name`` is '{company}_{MMmmYYYY}_{suffix}.xls[x]': the company code
    is the first part, month = characters 3-4 and year = last 4 characters of
    the second part. Unparsable parts give NULL, never an error.
    """
    parts = file_name_parts("source_name")
    df = raw
    for c in ("account", "centre", "section"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    company_code = F.coalesce(F.get(parts, 0), F.lit(""))
    date_part = F.coalesce(F.get(parts, 1), F.lit(""))
    df = df.withColumn("company_code", company_code).withColumn("date_part", date_part)
    df = (map_codes(df, "company_code", "company", company_names)
            .withColumn("month", try_number(F.substring("date_part", 3, 2), "int"))
            .withColumn("year", try_number(text_right("date_part", 4), "int")))
    names = F.array(*[F.lit(m) for m in MONTH_NAMES_UPPER])
    df = (df.withColumn("month_name", F.when(F.col("month").between(1, 12), F.element_at(names, F.col("month"))))
            .withColumn("monthly_balance", try_number("monthly_balance_txt", "decimal(18,2)"))
            .withColumn("report_date", first_of_month(F.col("year"), F.col("month")))
            .withColumn("category", F.coalesce("category", F.lit(NO_CATEGORY)))
            .withColumn("account_key", composite_key("account", "centre", "section")))
    return df.drop("monthly_balance_txt")


# Column names of the budget source and ours.
BUDGET_COLUMNS = {
    "cgib_categoria": "category",
    "cgib_totalbase": "base_total",
    "cgib_valorporcentaje": "percent_value",
    "cgib_empresa": "company_code",
    "cgib_ano": "year",
    "cgib_mes": "month",
    "cgib_concepto": "concept",
}


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed by a map; names that the frame lacks are ignored."""
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def transform_budget(raw: DataFrame) -> DataFrame:
    """Budget records -> monthly budget (E2). Source column names are renamed first.

    Month text: 'Total' for accumulations, a month name for 1-12. Rows of
    accumulated months and of categories containing 'T' are removed. NULL
    month or category rows are kept (they do not equal the excluded texts).
    """
    df = renamed(raw, BUDGET_COLUMNS)
    df = df.withColumn("month", F.col("month").cast("string"))
    df = df.withColumn("month_text", month_text("month"))
    df = df.withColumn("month", F.replace("month", F.lit("MESACUMULADO"), F.lit("00")))
    df = df.where(~F.coalesce(F.upper(F.trim("month")) == "ACUMULADO", F.lit(False)))
    df = df.withColumn("month_text", F.replace("month_text", F.lit("MESACUMULADO"), F.lit("Total")))
    df = df.where(~F.coalesce(F.col("category").contains("T"), F.lit(False)))
    df = df.where(~F.coalesce(F.lower(F.trim("month_text")) == "total", F.lit(False)))
    return df.withColumn("report_date", first_of_month(try_number("year", "int"), try_number("month", "int")))


def transform_template(raw: DataFrame) -> DataFrame:
    """Template sheet -> typed template: ``n`` integer (unparsable -> NULL), the rest text."""
    return raw.select(to_int(F.trim(F.col("n").cast("string"))).alias("n"),
                      *[F.col(c).cast("string").alias(c) for c in ("concept", "category", "parent", "ratio")])


def transform_categories(raw: DataFrame) -> DataFrame:
    """Category records -> category dimension with a display label.

    Metadata columns (names starting with '@') are dropped and a missing name
    or identifier is NULL before the label 'identifier name' is built.
    """
    df = raw.drop(*[c for c in raw.columns if c.startswith("@")])
    for c in ("name", "identifier"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df.select("name", "identifier", label_concat("identifier", "name").alias("label"))

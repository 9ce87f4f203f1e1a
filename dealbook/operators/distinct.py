"""Conditional distinct counts, sums and means in one two-level aggregation (A1-A3).

``COUNT(DISTINCT CASE WHEN cond THEN id END)`` for several different
conditions makes Spark expand every row once per distinct expression. Here the
rows are first combined per ``(group, id)`` (one flag per condition, partial
sums and counts), then per group. Both levels combine map-side, and the first
level spreads a hot group over many ids, so a group holding a third of the
rows does not land in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def two_level_aggregate(df: DataFrame, group_cols: list[str], id_col: str,
                        count_flags: dict[str, Column],
                        sums: dict[str, Column] | None = None,
                        means: dict[str, Column] | None = None) -> DataFrame:
    """Per group: distinct ids meeting each flag, sums, and exact means.

    ``sums[name]`` is summed over all rows (use ``when(c, x).otherwise(0)`` for
    ``SUM(CASE ... ELSE 0)``); ``means[name]`` is averaged over its non-NULL
    values (``AVG(CASE ... END)``), returned as ``sum / count`` in double.
    NULL ids are never counted, as in COUNT(DISTINCT).
    """
    sums = sums or {}
    means = means or {}
    idc = F.col(id_col)
    first = [F.max(F.when(cond & idc.isNotNull(), F.lit(1)).otherwise(F.lit(0))).alias(f"_f_{n}")
             for n, cond in count_flags.items()]
    first += [F.sum(expr).alias(f"_s_{n}") for n, expr in sums.items()]
    for n, expr in means.items():
        first += [F.sum(expr).alias(f"_ms_{n}"), F.count(expr).alias(f"_mc_{n}")]
    per_id = df.groupBy(*group_cols, id_col).agg(*first)

    second = [F.sum(f"_f_{n}").cast("long").alias(n) for n in count_flags]
    second += [F.sum(f"_s_{n}").alias(n) for n in sums]
    second += [F.try_divide(F.sum(f"_ms_{n}").cast("double"), F.sum(f"_mc_{n}").cast("double")).alias(n)
               for n in means]
    return per_id.groupBy(*group_cols).agg(*second)

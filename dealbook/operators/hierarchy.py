"""Statement template hierarchy: how often each leaf code counts in each total line.

The reference evaluates total lines (codes starting with 'T') one after the
other in template order ``n``: a total is the sum of its children as they
stand at that moment. A child total computed earlier (smaller ``n``) counts
with its computed value, a child total computed later counts with whatever
was posted under its own code. So a row of a total refers to rows of smaller
``n`` only, and the rows in the order of ``n`` are a topological order even of
a cyclic template.

The bridge is the matrix of path counts between totals and leaves, summed row
by row in that order: the counts of a total are the sum of its children's. A
leaf that is reached on many paths is one entry with its number of paths, so
the work is bounded by rows x leaves whatever the number of paths.

A line whose ``n`` is NULL (unparsable in the template sheet) sorts after
every other line, as ``ORDER BY n`` puts NULLs last.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

# Templates are statement layouts (tens of lines). A template of more rows is
# refused, so that what is derived from it may be broadcast.
TEMPLATE_MAX_ROWS = 2_000
_LAST = 2**31 - 1  # place of a line without n
# Counts are exact decimals of so many digits; values times counts must fit a decimal of 38.
MAX_COUNT = 10**18

BRIDGE_SCHEMA = "code string, targets array<struct<category:string,count:decimal(18,0)>>"


def path_counts(lines: list[tuple[int | None, str | None, str | None]]) -> dict[str, Counter]:
    """For every total code its leaf codes with their number of paths, from (n, category, parent) lines."""
    children: dict[str, list[str]] = {}
    places: dict[str, list[int]] = {}
    for n, category, parent in lines:
        if category is not None and parent is not None:
            children.setdefault(parent, []).append(category)
        if category is not None and category.startswith("T"):
            places.setdefault(category, []).append(_LAST if n is None else n)
    for own in places.values():
        own.sort()
    counts: dict[tuple[int, str], Counter] = {}
    for n, total in sorted({(n, total) for total, own in places.items() for n in own}):
        row: Counter = Counter()
        for child, times in Counter(children.get(total, ())).items():
            before = bisect_left(places.get(child, ()), n)
            if before:
                for leaf, paths in counts[places[child][before - 1], child].items():
                    row[leaf] += times * paths
            else:
                row[child] += times
        if any(c >= MAX_COUNT for c in row.values()):
            raise ValueError(f"a leaf counts more than {MAX_COUNT} times in the statement line {total}")
        counts[n, total] = row
    return {total: counts[own[-1], total] for total, own in places.items()}


def template_lines(template: DataFrame) -> list[tuple[int | None, str | None, str | None]]:
    """(n, category, parent) of a template, whose size is checked."""
    # In one partition, so that the limit takes one job.
    rows = template.select("n", "category", "parent").coalesce(1).limit(TEMPLATE_MAX_ROWS + 1).collect()
    if len(rows) > TEMPLATE_MAX_ROWS:
        raise ValueError(f"statement template has more than {TEMPLATE_MAX_ROWS} rows")
    return [(r["n"], r["category"], r["parent"]) for r in rows]


def template_bridge(spark: SparkSession, template: DataFrame) -> DataFrame:
    """``(code, targets)``: the codes a posting under ``code`` adds to, and how often.

    A code adds to itself unless it is a total code of the template (those
    are replaced by their computed value), and to every total that reaches it,
    as many times as it has paths. Codes absent from the result add only to
    themselves. Size: at most one row per template code, each array at most
    (template rows) long; rows of the driver, no Spark job but the read of the
    template.
    """
    totals = path_counts(template_lines(template))
    targets: dict[str, list[tuple[str, int]]] = {total: [] for total in totals}
    for total, leaves in totals.items():
        for leaf, count in leaves.items():
            targets.setdefault(leaf, [] if leaf in totals else [(leaf, 1)]).append((total, count))
    rows = [(code, [(t, Decimal(c)) for t, c in own]) for code, own in sorted(targets.items())]
    return spark.createDataFrame(rows, BRIDGE_SCHEMA)

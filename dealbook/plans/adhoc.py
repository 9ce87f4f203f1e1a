"""Guarded ad-hoc SELECT over registered views.

The reference runs the text on a read-only connection that sees its tables and
nothing else. Here the parsed and the analysed plan are walked before anything
runs: a query may read registered views only and call listed functions only.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

MAX_ROWS = 50
_READ_ONLY = re.compile(r"^\s*(SELECT|WITH)\b", re.IGNORECASE)
_CATALYST = "org.apache.spark.sql.catalyst."

#: Functions that a query may call, by kind; none reads a file, a setting, a session fact or calls a class.
FUNCTIONS = frozenset("""
any any_value approx_count_distinct avg bool_and bool_or collect_list collect_set corr count count_if every first
first_value grouping grouping_id kurtosis last last_value max max_by mean median min min_by mode percentile
percentile_approx percentile_cont percentile_disc regr_slope regr_intercept skewness some std stddev stddev_pop
stddev_samp sum try_avg try_sum var_pop var_samp variance
cume_dist dense_rank lag lead nth_value ntile percent_rank rank row_number
abs bround cbrt ceil ceiling degrees exp expm1 floor greatest hypot least ln log log10 log1p log2 mod negative pi pmod
positive pow power radians round sign signum sqrt sin cos tan asin acos atan atan2 width_bucket
try_add try_divide try_multiply try_subtract div
bigint binary boolean cast date decimal double float int smallint string timestamp tinyint try_cast to_char to_number
try_to_number
coalesce if ifnull isnotnull isnull nullif nvl nvl2 nanvl case when zeroifnull nullifzero isnan equal_null in not and or
ascii bit_length btrim char char_length character_length chr concat concat_ws contains endswith find_in_set
format_number format_string initcap instr lcase left len length levenshtein locate lower lpad ltrim mask overlay
position printf regexp regexp_count regexp_extract regexp_extract_all regexp_instr regexp_like regexp_replace
regexp_substr repeat replace reverse right rlike rpad rtrim sentences soundex space split split_part startswith substr
substring substring_index translate trim ucase unbase64 base64 upper like ilike
add_months date_add date_diff date_format date_from_unix_date date_part date_sub date_trunc dateadd datediff datepart
day dayname dayofmonth dayofweek dayofyear extract from_unixtime hour last_day make_date make_timestamp minute month
monthname months_between next_day quarter second to_date to_timestamp to_unix_timestamp trunc try_to_date
try_to_timestamp unix_date unix_timestamp weekday weekofyear year
array array_append array_compact array_contains array_distinct array_except array_intersect array_join array_max
array_min array_position array_prepend array_remove array_repeat array_size array_sort array_union arrays_overlap
arrays_zip cardinality element_at explode explode_outer exists filter flatten forall get aggregate inline
inline_outer map map_concat map_contains_key map_entries map_filter map_from_arrays map_keys map_values
named_struct posexplode posexplode_outer reduce sequence size slice sort_array stack struct transform
transform_keys transform_values zip_with
hash xxhash64 md5 sha sha1 sha2 crc32
""".split())


def _children(node) -> Iterator:
    for part in (node.children(), node.innerChildren()):
        for i in range(part.size()):
            yield part.apply(i)


def _expressions(node) -> Iterator:
    found = node.expressions()
    for i in range(found.size()):
        yield found.apply(i)


def _kind(node) -> str:
    return node.getClass().getName()


def _walk(plan, enter) -> Iterator:
    """Every plan and expression node below ``plan``, subqueries included; ``enter`` tells whether to go below a node."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        if not enter(node):
            continue
        todo += _children(node)
        if _is(node, "plans.QueryPlan"):
            todo += _expressions(node)
        if _is(node, "expressions.PlanExpression"):
            todo.append(node.plan())


def _is(node, kind: str) -> bool:
    from py4j.java_gateway import is_instance_of
    from pyspark import SparkContext

    return is_instance_of(SparkContext._active_spark_context._gateway, node, _CATALYST + kind)


def _parts(seq) -> list[str]:
    return [seq.apply(i) for i in range(seq.size())]


def _check_parsed(plan, views: set[str], functions: frozenset) -> None:
    """Refuses anything but a query, other functions, and relations that are neither registered nor named by WITH."""
    nodes = list(_walk(plan, lambda node: True))
    named = set()
    for node in nodes:
        if _kind(node).endswith(".UnresolvedWith"):
            named |= {part._1().lower() for part in _parts(node.cteRelations())}
    for node in nodes:
        kind = _kind(node)
        if _is(node, "plans.logical.Command") or _is(node, "plans.logical.ParsedStatement"):
            raise ValueError("only SELECT queries are allowed")
        if kind.endswith(".UnresolvedRelation"):
            name = ".".join(_parts(node.multipartIdentifier()))
            if name.lower() not in views | named:
                raise ValueError(f"only registered views can be read, not {name}")
        elif kind.endswith((".UnresolvedTableValuedFunction", ".UnresolvedTVFAliases")):
            raise ValueError("table functions cannot be called in FROM")
        elif kind.endswith((".UnresolvedFunction", ".UnresolvedGenerator")):
            name = ".".join(_parts(node.nameParts())) if kind.endswith("Function") else node.name().unquotedString()
            if name.lower() not in functions:
                raise ValueError(f"the function {name} is not allowed")


def _check_analysed(plan, views: set[str]) -> None:
    """Refuses every source of rows that does not lie below a registered view, and calls out of the engine."""
    def below(node):
        return not (_kind(node).endswith(".SubqueryAlias") and node.alias().lower() in views
                    and _kind(node.child()).endswith(".View"))

    leaves = ("plans.logical.OneRowRelation", "plans.logical.LocalRelation", "plans.logical.CTERelationRef")
    for node in _walk(plan, below):
        kind = _kind(node)
        if _is(node, "plans.logical.LogicalPlan"):
            if not below(node) or node.children().size():
                continue
            if not any(kind.startswith(_CATALYST + leaf) for leaf in leaves):
                raise ValueError(f"only registered views can be read, not a {kind.rsplit('.', 1)[1]}")
        elif kind.endswith(("Reflection", "ReflectionExpression", "UDF", "ScalaAggregator", "InputFileName")):
            raise ValueError(f"the function {kind.rsplit('.', 1)[1]} is not allowed")


def guarded_select(spark: SparkSession, sql: str, max_rows: int = MAX_ROWS,
                   views: Iterable[str] | None = None) -> DataFrame:
    """Run one read-only query over registered views and cap the result at ``max_rows`` rows.

    Only texts starting with SELECT (or WITH ... SELECT) are accepted. ``views``
    are the names that may be read, by default the session's temporary views;
    catalog tables, paths and table functions are refused, and so is every
    function outside ``FUNCTIONS``, all before the query runs. Errors are
    raised as ``ValueError`` with the engine's message. The cap is the feature
    (a preview), not a way to make the query cheap: Spark pushes the limit
    into the plan.
    """
    if not _READ_ONLY.match(sql or ""):
        raise ValueError("only SELECT queries are allowed")
    known = {v.lower() for v in views} if views is not None else {
        t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    try:
        _check_parsed(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), known, FUNCTIONS)
        df = spark.sql(sql)
        _check_analysed(df._jdf.queryExecution().analyzed(), known)
    except ValueError:
        raise
    except Exception as exc:  # noqa: BLE001 - surfaced to the caller as text
        raise ValueError(str(exc)) from exc
    return df.limit(max_rows)

"""DuckDB oracle SQL for every registered query.

Each text runs on the driver's pre-registered base tables; the fixture views
independent of the Spark plans.
"""

from __future__ import annotations

from dealbook.fixtures import duckdb_cte

# Parameters shared with __spark_entry__ (the same literal values).
SALES_YEAR, SALES_MONTH = 1997, 5


def _r2(x: str) -> str:
    """Half-away-from-zero rounding to 2 decimals on a double."""
    return f"(ROUND(CAST({x} AS DOUBLE) * 100) / 100)"


def _r1(x: str) -> str:
    return f"(ROUND(CAST({x} AS DOUBLE) * 10) / 10)"


def _period(col: str, year, month) -> str:
    parts = [f"YEAR({col}) = {int(year)}"] if year is not None else []
    parts += [f"MONTH({col}) = {int(month)}"] if month is not None else []
    return " AND ".join(parts) or "TRUE"


def sales_summary(year=None, month=None, orders: str = "sales_orders") -> str:
    """R1 from SURVEY section 2.4: period flags per order first, then filtered aggregates."""
    def mean(x: str) -> str:
        return _r2(f"CAST(SUM({x}) FILTER (WHERE noticed) AS DOUBLE) / NULLIF(COUNT({x}) FILTER (WHERE noticed), 0)")

    def count(condition: str) -> str:
        return f"COUNT(DISTINCT order_id) FILTER (WHERE {condition})"

    def total(x: str) -> str:
        return _r2(f"COALESCE(SUM({x}) FILTER (WHERE noticed), 0)")

    profits = ",\n  ".join(f"{total(f'p{i}')} AS sum_gp{i}, {mean(f'p{i}')} AS avg_gp{i}" for i in (1, 2, 3))
    return duckdb_cte([orders, "vehicle_stock"]) + f""",
plates AS (SELECT vin, MAX(registration_date) AS plate_date FROM vehicle_stock GROUP BY vin),
dated AS (
  SELECT *, TRY_CAST(order_date_txt AS DATE) AS ordered_on, TRY_CAST(notice_date_txt AS DATE) AS noticed_on
  FROM {orders} WHERE order_no IS NOT NULL AND state_code = 0
),
flagged AS (
  SELECT d.order_id, d.salesperson, d.file_no, d.financed_amount > 0 AS is_financed,
         IFNULL(gp1, 0) AS p1, IFNULL(gp2, 0) AS p2, IFNULL(gp3, 0) AS p3,
         100 * CAST(IFNULL(discount, 0) AS DECIMAL(20,10)) AS percent_off,
         plate_date IS NOT NULL AS has_plate,
         COALESCE({_period('noticed_on', year, month)}, FALSE) AS noticed,
         ordered_on IS NOT NULL AND ({_period('ordered_on', year, month)}) AS ordered
  FROM dated d LEFT JOIN plates USING (vin)
),
summary AS (
SELECT IFNULL(salesperson, 'Sin asignar') AS salesperson,
  {count('noticed AND has_plate')} AS plated, {count('noticed AND file_no IS NOT NULL')} AS uploaded,
  {count('noticed AND file_no IS NULL')} AS pending, {count('ordered')} AS orders, {count('noticed')} AS sales,
  {profits},
  {mean('percent_off')} AS avg_discount_pct, {count('noticed AND is_financed')} AS financed
FROM flagged GROUP BY flagged.salesperson
HAVING {count('ordered')} + {count('noticed')} > 0
)
"""


ORACLE: dict[str, str] = {}

ORACLE["sales_summary_month"] = sales_summary(SALES_YEAR, SALES_MONTH) + "SELECT * FROM summary"
ORACLE["sales_summary_dirty"] = sales_summary(SALES_YEAR, orders="sales_orders_dirty") + "SELECT * FROM summary"
ORACLE["sales_summary_all"] = sales_summary() + "SELECT * FROM summary"
ORACLE["sales_summary_totals"] = sales_summary(SALES_YEAR) + f"""
SELECT salesperson, plated, uploaded, pending, orders, sales, sum_gp1, avg_gp1, sum_gp2, avg_gp2,
       sum_gp3, avg_gp3, avg_discount_pct, financed, FALSE AS is_total FROM summary
UNION ALL
SELECT 'TOTALES', SUM(plated), SUM(uploaded), SUM(pending), SUM(orders), SUM(sales),
       {_r2('SUM(sum_gp1)')}, {_r2('AVG(avg_gp1)')}, {_r2('SUM(sum_gp2)')}, {_r2('AVG(avg_gp2)')},
       {_r2('SUM(sum_gp3)')}, {_r2('AVG(avg_gp3)')}, {_r2('AVG(avg_discount_pct)')}, SUM(financed), TRUE
FROM summary
"""
ORACLE["sales_kpis"] = sales_summary(SALES_YEAR) + """
SELECT CAST(COALESCE(SUM(plated),0) AS BIGINT) AS plated, CAST(COALESCE(SUM(uploaded),0) AS BIGINT) AS uploaded,
       CAST(COALESCE(SUM(pending),0) AS BIGINT) AS pending, CAST(COALESCE(SUM(orders),0) AS BIGINT) AS orders,
       CAST(COALESCE(SUM(sales),0) AS BIGINT) AS sales FROM summary
"""
for _name, _col in [("top_orders", "orders"), ("top_sales", "sales"), ("top_gp3", "avg_gp3"),
                    ("top_uploaded", "uploaded")]:
    ORACLE[_name] = sales_summary(SALES_YEAR) + f"""
SELECT * FROM summary
ORDER BY COALESCE(CAST({_col} AS DOUBLE), 0) DESC, salesperson ASC NULLS LAST, orders DESC
LIMIT 10
"""


def sales_by_type(year=None, month=None) -> str:
    """R3 from SURVEY section 2.4: distinct orders per pair, then their share of the person's."""
    return duckdb_cte(["sales_orders"]) + f""",
pairs AS (
  SELECT DISTINCT salesperson, sale_type, order_id
  FROM (SELECT *, TRY_CAST(notice_date_txt AS DATE) AS noticed_on FROM sales_orders)
  WHERE order_no IS NOT NULL AND state_code = 0 AND order_id IS NOT NULL AND ({_period('noticed_on', year, month)})
),
per_pair AS (SELECT salesperson, sale_type, COUNT(*) AS quantity FROM pairs GROUP BY ALL),
per_person AS (SELECT salesperson, SUM(quantity) AS everything FROM per_pair GROUP BY ALL),
shares AS (
  SELECT IFNULL(x.salesperson, 'Sin asignar') AS salesperson, IFNULL(x.sale_type, 'Sin tipo') AS sale_type,
         x.quantity, {_r1('x.quantity * CAST(100 AS DOUBLE) / p.everything')} AS share_pct
  FROM per_pair x JOIN per_person p ON p.salesperson IS NOT DISTINCT FROM x.salesperson
)
"""


ORACLE["sales_by_type_share"] = sales_by_type(SALES_YEAR, SALES_MONTH) + "SELECT * FROM shares"

# The pivot columns are the sale types present in the fixture at every scale.
SALE_TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "Sin tipo"]
_pivot_cols = ", ".join(f"CAST(COALESCE(SUM(CASE WHEN sale_type = '{t}' THEN quantity END), 0) AS BIGINT) AS \"{t}\""
                        for t in SALE_TYPES)
_pivot_tot = ", ".join(f"SUM(\"{t}\")" for t in SALE_TYPES)
ORACLE["sales_type_pivot"] = sales_by_type(SALES_YEAR) + f""",
wide AS (
SELECT salesperson, {_pivot_cols}, CAST(SUM(quantity) AS BIGINT) AS "TOTAL"
FROM shares GROUP BY salesperson
)
SELECT *, FALSE AS is_total FROM wide
UNION ALL
SELECT 'TOTALES', {_pivot_tot}, SUM("TOTAL"), TRUE FROM wide
"""

ORACLE["sales_years"] = duckdb_cte(["sales_orders"]) + """
SELECT DISTINCT CAST(YEAR(TRY_CAST(notice_date_txt AS DATE)) AS INT) AS year
FROM sales_orders
WHERE notice_date_txt IS NOT NULL AND YEAR(TRY_CAST(notice_date_txt AS DATE)) IS NOT NULL
"""

ORACLE["best_seller_year"] = duckdb_cte(["sales_orders"]) + f"""
SELECT COALESCE(salesperson, 'Sin asignar') AS salesperson, COUNT(DISTINCT order_id) AS sales
FROM sales_orders
WHERE state_code = 0 AND order_no IS NOT NULL AND YEAR(TRY_CAST(notice_date_txt AS DATE)) = {SALES_YEAR}
GROUP BY salesperson
ORDER BY sales DESC, 1 ASC
LIMIT 1
"""
ORACLE["pending_count"] = duckdb_cte(["sales_orders"]) + """
SELECT COUNT(DISTINCT order_id) AS pending FROM sales_orders
WHERE state_code = 0 AND order_no IS NOT NULL AND file_no IS NULL
"""
ORACLE["gp3_avg_by_salesperson"] = duckdb_cte(["sales_orders"]) + f"""
SELECT COALESCE(salesperson, 'Sin asignar') AS salesperson,
       {_r2('CAST(SUM(gp3) AS DOUBLE) / NULLIF(COUNT(gp3), 0)')} AS avg_gp3
FROM sales_orders WHERE state_code = 0 AND order_no IS NOT NULL
GROUP BY salesperson
"""
ORACLE["top_sale_type"] = duckdb_cte(["sales_orders"]) + """
SELECT COALESCE(sale_type, 'Sin tipo') AS sale_type, COUNT(*) AS orders
FROM sales_orders WHERE state_code = 0 AND order_no IS NOT NULL
GROUP BY sale_type
ORDER BY orders DESC, 1 ASC
LIMIT 1
"""
ORACLE["latest_stock_row"] = duckdb_cte(["vehicle_stock"]) + """
SELECT vin, registration_date FROM (
  SELECT vin, registration_date,
         ROW_NUMBER() OVER (PARTITION BY vin ORDER BY registration_date DESC) AS rn
  FROM vehicle_stock) WHERE rn = 1
"""


# --- P&L statement -------------------------------------------------------------

PNL_COMPANY, PNL_YEAR, PNL_MONTH = "EUROPE", 1997, 5
DRILL_CATEGORY = "A7"
MONTH_NAMES_SQL = "['Enero','Febrero','Marzo','Abril','Mayo','Junio','Julio','Agosto','Septiembre','Octubre','Noviembre','Diciembre']"

BUDGET_SQL = f"""budget AS (
  SELECT category, company_code, year, month, base_total,
         REPLACE(month_text0, 'MESACUMULADO', 'Total') AS month_text,
         TRY_CAST(CONCAT(CAST(TRY_CAST(TRIM(year) AS INT) AS VARCHAR), '-',
                         LPAD(CAST(TRY_CAST(TRIM(month) AS INT) AS VARCHAR), 2, '0'), '-01') AS DATE) AS report_date
  FROM (SELECT category, company_code, year, base_total,
               REPLACE(CAST(month AS VARCHAR), 'MESACUMULADO', '00') AS month,
               CASE WHEN UPPER(TRIM(month)) IN ('ACUMULADO', 'TOTAL') THEN 'Total'
                    WHEN TRY_CAST(UPPER(TRIM(month)) AS INT) BETWEEN 1 AND 12
                      THEN list_extract({MONTH_NAMES_SQL}, TRY_CAST(UPPER(TRIM(month)) AS INT))
                    ELSE month END AS month_text0
        FROM budget_raw)
  WHERE NOT COALESCE(UPPER(TRIM(month)) = 'ACUMULADO', FALSE)
    AND NOT COALESCE(category LIKE '%T%', FALSE)
    AND NOT COALESCE(LOWER(TRIM(REPLACE(month_text0, 'MESACUMULADO', 'Total'))) = 'total', FALSE)
)"""

def closure_sql(tmpl: str = "statement_template") -> str:
    return f"""walk(anc, node, ref_n) AS (
  SELECT category, category, COALESCE(n, 2147483647) FROM {tmpl} WHERE category LIKE 'T%'
  UNION ALL
  SELECT w.anc, c.category, CASE WHEN c.category LIKE 'T%' AND COALESCE(c.n, 2147483647) < w.ref_n
                                 THEN COALESCE(c.n, 2147483647) END
  FROM walk w JOIN {tmpl} c ON c.parent = w.node
  WHERE w.ref_n IS NOT NULL
),
closure AS (SELECT anc AS category, node AS leaf FROM walk WHERE ref_n IS NULL),
tcodes AS (SELECT DISTINCT category FROM {tmpl} WHERE category LIKE 'T%'),
tmpl_rows AS (SELECT n, category, concept, ratio, COALESCE(category LIKE 'T%', FALSE) AS is_total FROM {tmpl}),
ratio_code AS (
  SELECT ratio, UNNEST(regexp_extract_all(CASE WHEN strpos(ratio, '/') > 0 THEN substr(ratio, strpos(ratio, '/') + 1) END,
                                          '\\b([A-Z][A-Z0-9]*\\d+)\\b', 1)) AS code
  FROM (SELECT DISTINCT ratio FROM {tmpl} WHERE ratio IS NOT NULL)
)"""




CLOSURE_SQL = closure_sql()


def _values(p: str, leaf: str) -> str:
    """CTEs {p}_raw, {p}_vals (category, period, value) from a leaf CTE (category, month, value)."""
    return f""",
{p}_raw AS (SELECT category, month, value FROM {leaf} WHERE month IS NOT NULL),
{p}_vm AS (
  SELECT category, month, value FROM {p}_raw WHERE category NOT IN (SELECT category FROM tcodes)
  UNION ALL
  SELECT c.category, r.month, SUM(r.value) FROM closure c JOIN {p}_raw r ON r.category = c.leaf
  GROUP BY c.category, r.month
),
{p}_vals AS (
  SELECT category, CAST(month AS VARCHAR) AS period, value FROM {p}_vm
  UNION ALL
  SELECT category, 'Total', SUM(value) FROM {p}_vm GROUP BY category
)"""


def _periods(p: str, *leaves: str) -> str:
    months = " UNION ".join(f"SELECT CAST(month AS VARCHAR) AS period FROM {leaf} WHERE month IS NOT NULL" for leaf in leaves)
    exists = " OR ".join(f"EXISTS (SELECT 1 FROM {leaf})" for leaf in leaves)
    return f""",
{p}_periods AS ({months} UNION SELECT 'Total' WHERE {exists})"""


def _long(p: str, value_name: str) -> str:
    return f""",
{p}_den AS (
  SELECT rc.ratio, pp.period, SUM(COALESCE(v.value, 0)) AS denominator
  FROM ratio_code rc CROSS JOIN {p}_periods pp
  LEFT JOIN {p}_vals v ON v.category = rc.code AND v.period = pp.period
  GROUP BY rc.ratio, pp.period
),
{p}_long AS (
  SELECT t.n, t.category, t.concept, t.is_total, pp.period,
         CAST(COALESCE(v.value, 0) AS DOUBLE) AS {value_name},
         CASE WHEN COALESCE(d.denominator, 0) <> 0
              THEN CAST(COALESCE(v.value, 0) AS DOUBLE) / CAST(d.denominator AS DOUBLE) * 100 END AS pct
  FROM tmpl_rows t CROSS JOIN {p}_periods pp
  LEFT JOIN {p}_vals v ON v.category = t.category AND v.period = pp.period
  LEFT JOIN {p}_den d ON d.ratio = t.ratio AND d.period = pp.period
)"""


def pnl_base(company=PNL_COMPANY, year=PNL_YEAR, typed_template: bool = False) -> str:
    if typed_template:
        head = duckdb_cte(["ledger", "template_raw"], recursive=True) + """,
typed_template AS (SELECT TRY_CAST(TRIM(n) AS INT) AS n, concept, category, parent, ratio FROM template_raw)"""
        closure = closure_sql("typed_template")
    else:
        head = duckdb_cte(["ledger", "statement_template"], recursive=True).rstrip()
        closure = CLOSURE_SQL
    return head + f""",
{closure},
a_leaf AS (SELECT category, month, SUM(monthly_balance) AS value FROM ledger
           WHERE company = '{company}' AND year = {int(year)} GROUP BY category, month)
""" + _values("a", "a_leaf") + _periods("a", "a_leaf") + _long("a", "value")


def budget_base(company=PNL_COMPANY, year=PNL_YEAR) -> str:
    return duckdb_cte(["budget_raw", "statement_template", "dim_company"], recursive=True) + f""",
{BUDGET_SQL},
{CLOSURE_SQL},
b_leaf AS (SELECT category, TRY_CAST(month AS INT) AS month, SUM(base_total) AS value FROM budget
           WHERE company_code = (SELECT MIN(code) FROM dim_company WHERE company = '{company}')
             AND year = '{int(year)}'
           GROUP BY category, TRY_CAST(month AS INT))
""" + _values("b", "b_leaf") + _periods("b", "b_leaf") + _long("b", "budget")


def _wide(p: str, measures: list[str]) -> str:
    periods = [str(m) for m in range(1, 13)] + ["Total"]
    cols = ", ".join(f"MAX(CASE WHEN period = '{pp}' THEN {m} END) AS \"{m if m != 'value' else 'res'}_{pp}\""
                     for pp in periods for m in measures)
    return f"SELECT n, category, concept, is_total, {cols} FROM {p}_long GROUP BY n, category, concept, is_total"


ORACLE["pnl_long"] = pnl_base() + "SELECT * FROM a_long"
ORACLE["pnl_wide"] = pnl_base() + _wide("a", ["value", "pct"])
ORACLE["budget_wide"] = budget_base() + _wide("b", ["budget", "pct"])
ORACLE["company_code_lookup"] = duckdb_cte(["dim_company"]) + f"""
SELECT MIN(code) AS code FROM dim_company WHERE company = '{PNL_COMPANY}'
"""

ORACLE["pnl_vs_budget"] = duckdb_cte(["ledger", "budget_raw", "statement_template", "dim_company"], recursive=True) + f""",
{BUDGET_SQL},
{CLOSURE_SQL},
a_leaf AS (SELECT category, month, SUM(monthly_balance) AS value FROM ledger
           WHERE company = '{PNL_COMPANY}' AND year = {PNL_YEAR} GROUP BY category, month),
b_leaf AS (SELECT category, TRY_CAST(month AS INT) AS month, SUM(base_total) AS value FROM budget
           WHERE company_code = (SELECT MIN(code) FROM dim_company WHERE company = '{PNL_COMPANY}')
             AND year = '{PNL_YEAR}'
           GROUP BY category, TRY_CAST(month AS INT))
""" + _values("a", "a_leaf") + _values("b", "b_leaf") + _periods("ab", "a_leaf", "b_leaf") + """
SELECT t.n, t.category, t.concept, t.is_total, pp.period,
       CAST(COALESCE(a.value, 0) AS DOUBLE) AS real, CAST(COALESCE(b.value, 0) AS DOUBLE) AS budget,
       CAST(COALESCE(a.value, 0) AS DOUBLE) - CAST(COALESCE(b.value, 0) AS DOUBLE) AS diff,
       CASE WHEN CAST(COALESCE(b.value, 0) AS DOUBLE) <> 0
            THEN (CAST(COALESCE(a.value, 0) AS DOUBLE) - CAST(COALESCE(b.value, 0) AS DOUBLE))
                 / ABS(CAST(COALESCE(b.value, 0) AS DOUBLE)) * 100 END AS var_pct
FROM tmpl_rows t CROSS JOIN ab_periods pp
LEFT JOIN a_vals a ON a.category = t.category AND a.period = pp.period
LEFT JOIN b_vals b ON b.category = t.category AND b.period = pp.period
"""

ORACLE["pnl_vs_prior_year"] = duckdb_cte(["ledger", "statement_template"], recursive=True) + f""",
{CLOSURE_SQL},
c_leaf AS (SELECT category, month, SUM(monthly_balance) AS value FROM ledger
           WHERE company = '{PNL_COMPANY}' AND year = {PNL_YEAR} GROUP BY category, month),
p_leaf AS (SELECT category, month, SUM(monthly_balance) AS value FROM ledger
           WHERE company = '{PNL_COMPANY}' AND year = {PNL_YEAR - 1} GROUP BY category, month)
""" + _values("c", "c_leaf") + _values("p", "p_leaf") + f"""
SELECT t.n, t.category, t.concept, t.is_total,
       CAST(COALESCE(c.value, 0) AS DOUBLE) AS current, CAST(COALESCE(p.value, 0) AS DOUBLE) AS prior,
       CAST(COALESCE(c.value, 0) AS DOUBLE) - CAST(COALESCE(p.value, 0) AS DOUBLE) AS diff,
       CASE WHEN CAST(COALESCE(p.value, 0) AS DOUBLE) <> 0
            THEN (CAST(COALESCE(c.value, 0) AS DOUBLE) - CAST(COALESCE(p.value, 0) AS DOUBLE))
                 / ABS(CAST(COALESCE(p.value, 0) AS DOUBLE)) * 100 END AS var_pct
FROM tmpl_rows t
LEFT JOIN c_vals c ON c.category = t.category AND c.period = '{PNL_MONTH}'
LEFT JOIN p_vals p ON p.category = t.category AND p.period = '{PNL_MONTH}'
WHERE EXISTS (SELECT 1 FROM c_leaf WHERE month IS NOT NULL)
"""

_drill_cols = ", ".join(f"CAST(COALESCE(SUM(CASE WHEN month = {m} THEN monthly_balance END), 0) AS DOUBLE) AS balance_{m}"
                        for m in range(1, 13))
ORACLE["account_drilldown"] = duckdb_cte(["ledger"]) + f"""
SELECT account, account_name, centre_name, centre, section,
       CAST(COALESCE(SUM(CASE WHEN month IS NOT NULL THEN monthly_balance END), 0) AS DOUBLE) AS total,
       {_drill_cols}
FROM ledger
WHERE company = '{PNL_COMPANY}' AND year = {PNL_YEAR} AND category = '{DRILL_CATEGORY}'
GROUP BY account, account_name, centre_name, centre, section
"""

ORACLE["ledger_companies"] = duckdb_cte(["dim_company"]) + "SELECT DISTINCT company FROM dim_company"
ORACLE["ledger_years"] = duckdb_cte(["dim_time", "ledger"]) + """
SELECT DISTINCT CAST(dt.year AS INT) AS year FROM dim_time dt
WHERE EXISTS (SELECT 1 FROM ledger b WHERE CAST(b.year AS INT) = dt.year)
"""

ORACLE["pnl_kpis"] = pnl_base() + """,
tot AS (SELECT category, value FROM a_long WHERE is_total AND period = 'Total'),
ser AS (SELECT CAST(m.period AS INT) AS month, COALESCE(MAX(l.value), 0) AS v
        FROM (SELECT DISTINCT period FROM a_long WHERE period <> 'Total') m
        LEFT JOIN a_long l ON l.period = m.period AND l.category = 'T18' AND l.is_total
        GROUP BY m.period)
SELECT COALESCE((SELECT MAX(value) FROM tot WHERE category = 'T18'), 0) AS pnl_total,
       COALESCE((SELECT MAX(value) FROM tot WHERE category = 'T13'), 0) AS net_total,
       ABS(COALESCE((SELECT MAX(value) FROM tot WHERE category = 'T14'), 0)) AS general_costs,
       ABS(COALESCE((SELECT MAX(value) FROM tot WHERE category = 'T15'), 0)) AS staff_costs,
       (SELECT month FROM ser ORDER BY v DESC, month DESC LIMIT 1) AS best_month,
       (SELECT v FROM ser ORDER BY v DESC, month DESC LIMIT 1) AS best_value,
       (SELECT month FROM ser ORDER BY v ASC, month DESC LIMIT 1) AS worst_month,
       (SELECT v FROM ser ORDER BY v ASC, month DESC LIMIT 1) AS worst_value
"""

ORACLE["pnl_best_worst_month"] = pnl_base() + """,
ser AS (SELECT CAST(m.period AS INT) AS month, COALESCE(MAX(l.value), 0) AS v
        FROM (SELECT DISTINCT period FROM a_long WHERE period <> 'Total') m
        LEFT JOIN a_long l ON l.period = m.period AND l.category = 'T18' AND l.is_total
        GROUP BY m.period)
SELECT (SELECT month FROM ser ORDER BY v DESC, month DESC LIMIT 1) AS best_month,
       (SELECT v FROM ser ORDER BY v DESC, month DESC LIMIT 1) AS best_value,
       (SELECT month FROM ser ORDER BY v ASC, month DESC LIMIT 1) AS worst_month,
       (SELECT v FROM ser ORDER BY v ASC, month DESC LIMIT 1) AS worst_value
"""

ORACLE["pnl_series"] = pnl_base() + """
SELECT CAST(period AS INT) AS month,
  COALESCE(MAX(CASE WHEN is_total AND category = 'T18' THEN value END), 0) AS pnl,
  COALESCE(MAX(CASE WHEN is_total AND category = 'T13' THEN value END), 0) AS net_total,
  COALESCE(MAX(CASE WHEN is_total AND category = 'T2' THEN value END), 0) AS net_new,
  COALESCE(MAX(CASE WHEN is_total AND category = 'T4' THEN value END), 0) AS net_used,
  COALESCE(MAX(CASE WHEN is_total AND category = 'T12' THEN value END), 0) AS net_after_sales,
  MAX(CASE WHEN is_total AND category = 'T1' THEN pct END) AS gross_new_pct,
  MAX(CASE WHEN is_total AND category = 'T2' THEN pct END) AS net_new_pct,
  MAX(CASE WHEN is_total AND category = 'T13' THEN pct END) AS net_total_pct,
  MAX(CASE WHEN is_total AND category = 'T18' THEN pct END) AS pnl_pct
FROM a_long WHERE period <> 'Total' GROUP BY period
"""

ORACLE["pnl_waterfall"] = pnl_base() + """,
tv AS (SELECT category, MAX(value) AS v FROM a_long WHERE is_total AND period = 'Total' GROUP BY category),
g AS (SELECT COALESCE((SELECT v FROM tv WHERE category = 'T13'), 0) AS t13,
             COALESCE((SELECT v FROM tv WHERE category = 'T14'), 0) AS t14,
             COALESCE((SELECT v FROM tv WHERE category = 'T15'), 0) AS t15,
             COALESCE((SELECT v FROM tv WHERE category = 'T16'), 0) AS t16,
             COALESCE((SELECT v FROM tv WHERE category = 'T17'), 0) AS t17,
             COALESCE((SELECT v FROM tv WHERE category = 'T18'), 0) AS t18)
SELECT 1 AS step, 'Net total' AS name, t13 - 0 AS value FROM g UNION ALL
SELECT 2, 'General costs', t14 - 0 FROM g UNION ALL
SELECT 3, 'Staff costs', t15 - 0 FROM g UNION ALL
SELECT 4, 'Result I+A', t16 - 0 FROM g UNION ALL
SELECT 5, 'Interest+Amort.', t17 - t16 FROM g UNION ALL
SELECT 6, 'Operating result', t17 - 0 FROM g UNION ALL
SELECT 7, 'Other', t18 - t17 FROM g UNION ALL
SELECT 8, 'P&L', t18 - 0 FROM g
"""

ORACLE["ratio_denominators"] = pnl_base() + """,
rc AS (SELECT n, ratio, codes FROM (
  SELECT n, ratio, regexp_extract_all(CASE WHEN strpos(ratio, '/') > 0 THEN substr(ratio, strpos(ratio, '/') + 1) END,
                                      '\\b([A-Z][A-Z0-9]*\\d+)\\b', 1) AS codes
  FROM statement_template WHERE ratio IS NOT NULL)),
rcx AS (SELECT n, ratio, CAST(UNNEST(range(len(codes))) AS INT) AS pos, UNNEST(codes) AS code FROM rc)
SELECT rcx.n, rcx.ratio, rcx.pos, rcx.code, CAST(COALESCE(v.value, 0) AS DOUBLE) AS code_value
FROM rcx LEFT JOIN a_vals v ON v.category = rcx.code AND v.period = 'Total'
"""


# --- ETL, sources and sinks ----------------------------------------------------

# A total may stand in several lines: its last row counts, and a child total counts as of its last row before.
ORACLE["pnl_odd_template"] = duckdb_cte(["ledger", "statement_template_odd"], recursive=True) + f""",
total_ns AS (SELECT category, list(n) AS ns FROM statement_template_odd WHERE category LIKE 'T%' GROUP BY category),
{closure_sql("statement_template_odd").replace(
    "SELECT category, category, COALESCE(n, 2147483647) FROM statement_template_odd WHERE category LIKE 'T%'",
    "SELECT category, category, list_max(ns) FROM total_ns").replace(
    """CASE WHEN c.category LIKE 'T%' AND COALESCE(c.n, 2147483647) < w.ref_n
                                 THEN COALESCE(c.n, 2147483647) END""",
    "list_max(list_filter(t.ns, lambda x: x < w.ref_n))").replace(
    "ON c.parent = w.node", "ON c.parent = w.node LEFT JOIN total_ns t ON t.category = c.category")},
a_leaf AS (SELECT category, month, SUM(monthly_balance) AS value FROM ledger
           WHERE company = '{PNL_COMPANY}' AND year = {PNL_YEAR} GROUP BY category, month)
""" + _values("a", "a_leaf") + _periods("a", "a_leaf") + _long("a", "value") + "SELECT * FROM a_long"

# Company code -> name map used for the fixture ledger files (J9); codes not
# listed fall back to themselves.
FIXTURE_COMPANY_NAMES = {"BalanceAlpha": "ALPHA MOTOR", "BalanceBeta": "BETA MOTOR", "BalanceGamma": "GAMMA MOTOR"}
MONTH_NAMES_UPPER_SQL = MONTH_NAMES_SQL.upper()
_map_sql = "CASE company_code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sorted(FIXTURE_COMPANY_NAMES.items())) + " ELSE company_code END"

ETL_LEDGER_SQL = f"""etl_ledger AS (
  SELECT source_name, account, account_name, centre_name, centre, section,
         COALESCE(category, 'without_category') AS category,
         company_code, date_part, {_map_sql} AS company, month, year,
         CASE WHEN month BETWEEN 1 AND 12 THEN list_extract({MONTH_NAMES_UPPER_SQL}, month) END AS month_name,
         TRY_CAST(TRIM(monthly_balance_txt) AS DECIMAL(18,2)) AS monthly_balance,
         CASE WHEN year IS NOT NULL AND month IS NOT NULL
              THEN TRY_CAST(CONCAT(CAST(year AS VARCHAR), '-', LPAD(CAST(month AS VARCHAR), 2, '0'), '-01') AS DATE) END AS report_date,
         CONCAT_WS('-', COALESCE(account, ''), COALESCE(CAST(centre AS VARCHAR), ''), COALESCE(CAST(section AS VARCHAR), '')) AS account_key
  FROM (
    SELECT *, TRY_CAST(TRIM(substr(date_part, 3, 2)) AS INT) AS month,
              TRY_CAST(TRIM(right(date_part, 4)) AS INT) AS year
    FROM (
      SELECT *, COALESCE(str_split(regexp_replace(source_name, '\\.xlsx?$', '', 'i'), '_')[1], '') AS company_code,
                COALESCE(str_split(regexp_replace(source_name, '\\.xlsx?$', '', 'i'), '_')[2], '') AS date_part
      FROM ledger_raw)))"""

LANDED_LEAF = "company = 'ALPHA MOTOR'"
_landed_head = duckdb_cte(["ledger_raw", "statement_template"], recursive=True) + f""",
{ETL_LEDGER_SQL},
{CLOSURE_SQL},
a_leaf AS (SELECT category, month, SUM(monthly_balance) AS value FROM etl_ledger
           WHERE {LANDED_LEAF} AND year = {PNL_YEAR} GROUP BY category, month)
"""
ORACLE["pnl_from_landed_ledger"] = (_landed_head + _values("a", "a_leaf") + _periods("a", "a_leaf")
                                    + _long("a", "value") + "SELECT * FROM a_long")
_landed_cols = ", ".join(f"CAST(COALESCE(SUM(CASE WHEN month = {m} THEN monthly_balance END), 0) AS DOUBLE) AS balance_{m}"
                         for m in range(1, 14))
ORACLE["drilldown_from_landed_ledger"] = duckdb_cte(["ledger_raw"]) + f""", {ETL_LEDGER_SQL}
SELECT account, account_name, centre_name, centre, section,
       CAST(COALESCE(SUM(CASE WHEN month IS NOT NULL THEN monthly_balance END), 0) AS DOUBLE) AS total, {_landed_cols}
FROM etl_ledger WHERE {LANDED_LEAF} AND year = {PNL_YEAR} AND category = '{DRILL_CATEGORY}'
GROUP BY account, account_name, centre_name, centre, section
"""

ORACLE["etl_ledger"] = duckdb_cte(["ledger_raw"]) + f", {ETL_LEDGER_SQL}\nSELECT * FROM etl_ledger"
ORACLE["load_ledger_files"] = ORACLE["etl_ledger"]
ORACLE["sales_summary_bucketed"] = ORACLE["sales_summary_dirty"]
ORACLE["sales_summary_pruned"] = ORACLE["sales_summary_month"]
ORACLE["sales_by_type_pruned"] = ORACLE["sales_by_type_share"]
ORACLE["sales_summary_incremental"] = ORACLE["sales_summary_dirty"]
ORACLE["company_name_map"] = duckdb_cte(["ledger_raw"]) + f", {ETL_LEDGER_SQL}\nSELECT DISTINCT company_code, company FROM etl_ledger"
ORACLE["company_name_table"] = duckdb_cte(["ledger_raw", "company_names"]) + f""", {ETL_LEDGER_SQL}
SELECT e.company_code, COALESCE(c.company, e.company_code) AS company, COUNT(*) AS postings
FROM etl_ledger e LEFT JOIN company_names c ON c.code = e.company_code GROUP BY 1, 2
"""
ORACLE["load_drifted"] = duckdb_cte(["ledger_raw"]) + """
SELECT COUNT(*) FILTER (WHERE NOT bad) AS rows, COUNT(*) FILTER (WHERE bad) AS rejects,
       COUNT(*) FILTER (WHERE NOT bad AND money IS NULL) AS unparsed,
       CAST(COALESCE(SUM(money) FILTER (WHERE NOT bad), 0) AS DOUBLE) AS money, COUNT(*) AS stored,
       CAST(1 AS BIGINT) AS skipped_files
FROM (SELECT section = 7 AND source_name NOT LIKE '%.XLS' AS bad,
             TRY_CAST(TRIM(monthly_balance_txt) AS DECIMAL(18,2)) AS money FROM ledger_raw)
"""
ORACLE["etl_budget"] = duckdb_cte(["budget_raw"]) + f", {BUDGET_SQL}\nSELECT * FROM budget"
ORACLE["budget_source_names"] = ORACLE["etl_budget"]
ETL_TEMPLATE_SQL = "SELECT TRY_CAST(TRIM(n) AS INT) AS n, concept, category, parent, ratio FROM template_raw"
ORACLE["template_coverage"] = duckdb_cte(["template_raw", "ledger"]) + f"""
SELECT t.n, t.concept, t.category, t.parent, t.ratio,
       CAST(COALESCE(p.postings, 0) AS BIGINT) AS postings, CAST(COALESCE(p.amount, 0) AS DOUBLE) AS amount
FROM ({ETL_TEMPLATE_SQL}) t
LEFT JOIN (SELECT category, COUNT(*) AS postings, SUM(monthly_balance) AS amount FROM ledger GROUP BY category) p
  ON p.category = t.category
"""
ORACLE["pnl_from_template_sheet"] = pnl_base(typed_template=True) + "SELECT * FROM a_long"
ETL_CATEGORIES_SQL = ("SELECT name, identifier, TRIM(CONCAT(COALESCE(identifier, ''), ' ', COALESCE(name, ''))) AS label "
                      "FROM category_raw")
ORACLE["etl_categories"] = duckdb_cte(["category_raw"]) + ETL_CATEGORIES_SQL
ORACLE["load_json_pages"] = ORACLE["etl_categories"]
ORACLE["csv_roundtrip"] = ORACLE["sales_by_type_share"]
ORACLE["overwrite_count"] = duckdb_cte(["ledger"]) + "SELECT COUNT(*) AS rows FROM ledger"
ORACLE["summary_materialised"] = ORACLE["sales_summary_month"]
ORACLE["totals_excluded"] = sales_summary(SALES_YEAR) + "SELECT * FROM summary"
ORACLE["nan_to_null"] = duckdb_cte(["sales_orders"]) + "SELECT order_id, CAST(gp2 AS DOUBLE) AS gp2 FROM sales_orders"
ORACLE["month_list"] = duckdb_cte(["ledger"]) + f"""
SELECT DISTINCT CAST(month AS INT) AS month FROM ledger
WHERE company = '{PNL_COMPANY}' AND year = {PNL_YEAR} AND month IS NOT NULL
"""
ADHOC_SQL = ("SELECT COALESCE(salesperson, 'Sin asignar') AS salesperson, COUNT(*) AS active_orders "
             "FROM sales_orders WHERE state_code = 0 AND order_no IS NOT NULL "
             "GROUP BY salesperson ORDER BY active_orders DESC, salesperson LIMIT 50")
PREVIEW_SQL = "SELECT order_id, salesperson, gp1 FROM sales_orders WHERE state_code = 0 ORDER BY gp1 DESC, order_id"
ORACLE["adhoc_preview"] = duckdb_cte(["sales_orders"]) + PREVIEW_SQL + " LIMIT 50"
ORACLE["adhoc_select"] = duckdb_cte(["sales_orders"]) + ADHOC_SQL

_acct = "round_even(CAST(gp3 AS DOUBLE), 0)"
ORACLE["scalar_battery"] = duckdb_cte(["sales_orders"]) + f""",
s AS (SELECT *, CONCAT(COALESCE(sale_type, ''), '_MM', LPAD(CAST(order_id % 14 AS VARCHAR), 2, '0'), '1997_v', '.XlSx') AS file_like,
             CASE WHEN CAST(gp2 AS DOUBLE) <> 0 THEN CAST(gp1 AS DOUBLE) / CAST(gp2 AS DOUBLE) * 100 END AS pct
      FROM sales_orders),
p AS (SELECT *, str_split(regexp_replace(file_like, '\\.xlsx?$', '', 'i'), '_') AS parts FROM s)
SELECT order_id,
  TRY_CAST(notice_date_txt AS DATE) AS f01_notice_date,
  CAST(YEAR(TRY_CAST(notice_date_txt AS DATE)) AS INT) AS f02_year,
  CAST(MONTH(TRY_CAST(notice_date_txt AS DATE)) AS INT) AS f02_month,
  COALESCE(salesperson, 'Sin asignar') AS f03_label,
  ROUND(CAST(gp3 AS DOUBLE) / CAST(7 AS DOUBLE) * 100) / 100 AS f04_round,
  CAST(ABS(gp3) AS DOUBLE) AS f05_abs,
  CAST(order_id % 1000 AS INT) AS f06_int,
  pct AS f07_pct,
  CASE WHEN CAST(gp2 AS DOUBLE) <> 0 THEN CAST(gp1 - gp3 AS DOUBLE) / ABS(CAST(gp2 AS DOUBLE)) * 100 END AS f08_var,
  CAST(order_id % 10 AS DOUBLE) * 100 / CAST(7 AS DOUBLE) AS f09_share,
  parts[1] AS f11_company,
  parts[2] AS f11_date,
  TRY_CAST(TRIM(substr(parts[2], 3, 2)) AS INT) AS f12_month,
  right(parts[2], 4) AS f12_year,
  TRY_CAST(TRIM(order_no) AS DOUBLE) AS f13_number,
  LPAD(CAST(order_id % 100 AS VARCHAR), 3, '0') AS f14_pad,
  TRY_CAST(CONCAT('1997-', LPAD(CAST(order_id % 14 AS VARCHAR), 2, '0'), '-01') AS DATE) AS f15_first,
  COALESCE(sale_type, '') AS f16_fill,
  CONCAT_WS('-', COALESCE(order_no, ''), COALESCE(CAST(file_no AS VARCHAR), ''), COALESCE(sale_type, '')) AS f17_key,
  TRIM(CONCAT(COALESCE(salesperson, ''), ' ', COALESCE(sale_type, ''))) AS f18_label,
  CASE WHEN TRY_CAST(CAST(order_id % 15 AS VARCHAR) AS INT) BETWEEN 1 AND 12
       THEN list_extract({MONTH_NAMES_SQL}, CAST(order_id % 15 AS INT)) ELSE CAST(order_id % 15 AS VARCHAR) END AS f19_month_text,
  REPLACE(COALESCE(sale_type, ''), '-', '00') AS f20_replace,
  UPPER(TRIM(COALESCE(sale_type, ''))) AS f21_upper,
  COALESCE(starts_with(order_no, 'T'), FALSE) AS f22_starts,
  contains(sale_type, 'LOW') AS f22_contains,
  CASE WHEN {_acct} IS NULL THEN ''
       WHEN {_acct} < 0 THEN CONCAT('(', REPLACE(format('{{:,}}', CAST(ABS({_acct}) AS BIGINT)), ',', '.'), ')')
       ELSE REPLACE(format('{{:,}}', CAST({_acct} AS BIGINT)), ',', '.') END AS f24_accounting,
  CASE WHEN pct IS NULL OR isnan(pct) THEN '' ELSE CONCAT(printf('%.2f', pct), ' %') END AS f25_percent,
  CASE WHEN CAST(order_id % 13 AS INT) BETWEEN 1 AND 12
       THEN list_extract({MONTH_NAMES_SQL}, CAST(order_id % 13 AS INT)) ELSE CAST(order_id % 13 AS VARCHAR) END AS f26_month,
  CASE WHEN gp3 > 0 THEN 'pos' WHEN gp3 < 0 THEN 'neg' WHEN gp3 = 0 THEN 'zero' END AS f27_sign,
  TRY_CAST(file_no % 100000 AS INT) AS f28_int
FROM p
"""

_month_titles = ["Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio", "Agosto", "Septiembre",
                 "Octubre", "Noviembre", "Diciembre"]
_export_cols = ", ".join(
    f"COALESCE(MAX(CASE WHEN period = '{p}' THEN value END), 0) AS \"{lbl} Resultado\", "
    f"MAX(CASE WHEN period = '{p}' THEN pct END) AS \"{lbl} %\""
    for p, lbl in [(str(i + 1), _month_titles[i]) for i in range(12)] + [("Total", "Total")])
ORACLE["pnl_export"] = pnl_base() + f"""
SELECT category AS "Categoría", concept AS "Concepto", {_export_cols}
FROM a_long GROUP BY n, category, concept, is_total
"""
# The same table as lines of a delimited text: numbers written out, missing percentages empty.
_periods_titled = [(str(i + 1), _month_titles[i]) for i in range(12)] + [("Total", "Total")]
_line_text = " || ';' || ".join(
    ["COALESCE(category, '')", "COALESCE(concept, '')"] + [
        f"COALESCE(regexp_replace(CAST({value} AS VARCHAR), '\\.0$', ''), '')" for p, _ in _periods_titled for value in (
            f"COALESCE(MAX(CASE WHEN period = '{p}' THEN value END), 0)", f"MAX(CASE WHEN period = '{p}' THEN pct END) + 0")])
_line_header = ";".join(["Categoría", "Concepto"] + [f"{t} {m}" for _, t in _periods_titled for m in ("Resultado", "%")])
ORACLE["pnl_export_file"] = pnl_base() + f"""
SELECT 0 AS line, '{_line_header}' AS text
UNION ALL
SELECT CAST(row_number() OVER (ORDER BY n) AS INT) AS line, text
FROM (SELECT n, {_line_text} AS text FROM a_long GROUP BY n, category, concept, is_total)
"""
_fmt_v = "round_even(value, 0)"
ORACLE["pnl_formatted"] = pnl_base() + f"""
SELECT n, category, concept, period,
  CASE WHEN {_fmt_v} IS NULL THEN ''
       WHEN {_fmt_v} < 0 THEN CONCAT('(', REPLACE(format('{{:,}}', CAST(ABS({_fmt_v}) AS BIGINT)), ',', '.'), ')')
       ELSE REPLACE(format('{{:,}}', CAST({_fmt_v} AS BIGINT)), ',', '.') END AS value_text,
  CASE WHEN pct IS NULL OR isnan(pct) THEN '' ELSE CONCAT(printf('%.2f', pct), ' %') END AS pct_text,
  CASE WHEN value > 0 THEN 'pos' WHEN value < 0 THEN 'neg' WHEN value = 0 THEN 'zero' END AS value_sign
FROM a_long
"""

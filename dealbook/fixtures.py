"""Fixture tables (FIXTURES.md) derived from the driver's TPC-H-like Parquet.

Each fixture is one portable SQL text with ``{table}`` placeholders. Spark
binds the placeholders to DataFrames (``spark.sql(text, orders=df, ...)``);
the DuckDB oracle renders them to the plain table names. The same text
therefore defines the input of both engines.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

FIXTURE_SQL: dict[str, str] = {
    "sales_orders": """
SELECT o.o_orderkey AS order_id,
 CASE WHEN o.o_orderkey % 37 = 0 THEN NULL ELSE CONCAT('P', CAST(o.o_orderkey AS STRING)) END AS order_no,
 CASE WHEN o.o_orderstatus = 'P' THEN 1 ELSE 0 END AS state_code,
 CASE WHEN n.n_nationkey % 9 = 0 THEN NULL ELSE n.n_name END AS salesperson,
 o.o_orderkey AS vin,
 CASE WHEN o.o_orderpriority LIKE '4%' THEN NULL ELSE o.o_orderkey END AS file_no,
 SUBSTRING(CAST(o.o_orderdate AS STRING), 1, 10) AS order_date_txt,
 CASE WHEN o.o_orderkey % 23 = 0 THEN 'pending' WHEN o.o_orderkey % 29 = 0 THEN NULL
      ELSE SUBSTRING(CAST(o.o_orderdate + INTERVAL 20 DAY AS STRING), 1, 10) END AS notice_date_txt,
 CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE o.o_orderpriority END AS sale_type,
 CAST(o.o_totalprice AS DECIMAL(18,2)) AS gp1,
 CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE CAST(c.c_acctbal AS DECIMAL(18,2)) END AS gp2,
 CAST(o.o_totalprice AS DECIMAL(18,2)) - CAST(c.c_acctbal AS DECIMAL(18,2)) AS gp3,
 CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE (o.o_orderkey % 10) / CAST(100 AS DOUBLE) END AS discount,
 CASE WHEN o.o_orderkey % 3 = 0 THEN CAST(o.o_totalprice AS DECIMAL(18,2)) WHEN o.o_orderkey % 3 = 1 THEN 0 ELSE NULL END AS financed_amount
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
""",
    # Orders as they come in practice: a third without a VIN, a third with one VIN, some entered twice.
    "sales_orders_dirty": """
SELECT order_id, order_no, state_code, salesperson,
 CASE WHEN order_id % 3 = 0 THEN NULL WHEN order_id % 3 = 1 THEN 7 ELSE vin END AS vin,
 file_no, order_date_txt, notice_date_txt, sale_type, gp1, gp2, gp3, discount, financed_amount
FROM (SELECT *, 1 AS entry FROM {sales_orders} UNION ALL SELECT *, 2 AS entry FROM {sales_orders} WHERE order_id % 5 = 0) AS twice
""",
    "vehicle_stock": """
SELECT l_orderkey AS vin, CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_shipdate AS DATE) END AS registration_date FROM {lineitem}
""",
    "ledger": """
SELECT r.r_name AS company, YEAR(l.l_shipdate) AS year, MONTH(l.l_shipdate) AS month,
 CASE WHEN l.l_partkey % 13 = 0 THEN 'without_category' ELSE CONCAT('A', CAST(l.l_partkey % 13 AS STRING)) END AS category,
 CAST(6000 + l.l_suppkey AS STRING) AS account, s.s_name AS account_name, n.n_name AS centre_name, n.n_nationkey AS centre, l.l_linenumber AS section,
 CASE WHEN l.l_returnflag = 'R' THEN -CAST(l.l_extendedprice AS DECIMAL(18,2)) ELSE CAST(l.l_extendedprice AS DECIMAL(18,2)) END AS monthly_balance
FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN {nation} n ON s.s_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
""",
    "ledger_raw": """
SELECT CONCAT(CASE r.r_regionkey WHEN 0 THEN 'BalanceAlpha' WHEN 1 THEN 'BalanceBeta' WHEN 2 THEN 'BalanceGamma' ELSE CONCAT('Balance', r.r_name) END,
   CASE WHEN l.l_orderkey % 97 = 0 THEN '' WHEN l.l_orderkey % 89 = 0 THEN '_MM131997_v1'
        ELSE CONCAT('_MM', LPAD(CAST(MONTH(l.l_shipdate) AS STRING), 2, '0'), CAST(YEAR(l.l_shipdate) AS STRING), '_v1') END,
   CASE WHEN l.l_orderkey % 2 = 0 THEN '.xlsx' ELSE '.XLS' END) AS source_name,
 CAST(6000 + l.l_suppkey AS STRING) AS account, s.s_name AS account_name, n.n_name AS centre_name,
 CASE WHEN l.l_partkey % 31 = 0 THEN NULL ELSE n.n_nationkey END AS centre, l.l_linenumber AS section,
 CASE WHEN l.l_partkey % 13 = 0 THEN NULL ELSE CONCAT('A', CAST(l.l_partkey % 13 AS STRING)) END AS category,
 CASE WHEN l.l_partkey % 61 = 0 THEN 'n/a' ELSE CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) AS STRING) END AS monthly_balance_txt
FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN {nation} n ON s.s_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
""",
    "budget_raw": """
SELECT CASE WHEN o.o_orderkey % 53 = 0 THEN 'T1' ELSE CONCAT('A', CAST(o.o_orderkey % 12 + 1 AS STRING)) END AS category,
 n.n_regionkey AS company_code, CAST(YEAR(o.o_orderdate) AS STRING) AS year,
 CASE WHEN o.o_orderkey % 41 = 0 THEN 'ACUMULADO' WHEN o.o_orderkey % 43 = 0 THEN 'Total' WHEN o.o_orderkey % 47 = 0 THEN 'MESACUMULADO' ELSE CAST(MONTH(o.o_orderdate) AS STRING) END AS month,
 CAST(o.o_totalprice AS DECIMAL(18,2)) AS base_total
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
""",
    "statement_template": """
SELECT * FROM (VALUES
 (1,'Units','A1',CAST(NULL AS STRING),CAST(NULL AS STRING)),(2,'New revenue','A2','T1','A2/A1'),(3,'New cost','A3','T1','A3/A2'),(4,'Gross new','T1','T2','T1/A2'),
 (5,'New bonus','A4','T2',NULL),(6,'Net new','T2','T13','T2/A2'),(7,'Used revenue','A5','T4',NULL),(8,'Used cost','A6','T4','A6/A5'),(9,'Net used','T4','T13','T4/A5'),
 (10,'After-sales','A7','T12',NULL),(11,'Workshop','A8','T12',NULL),(12,'Net after-sales','T12','T13','T12/A7+A8'),(13,'Net total','T13','T16','T13/A2+A5+A7+A8'),
 (14,'Rent','A9','T14',NULL),(15,'General costs','T14','T16','T14/T13'),(16,'Payroll','A10','T15',NULL),(17,'Staff costs','T15','T16','T15/T13'),
 (18,'Result I+A','T16','T17','T16/T13'),(19,'Interest','A11','T17',NULL),(20,'Operating result','T17','T18','T17/T13'),(21,'Other','A12','T18',NULL),(22,'P&L','T18',NULL,'T18/T13')
) AS t(n, concept, category, parent, ratio)
""",
    "template_raw": """
SELECT CASE WHEN n = 5 THEN 'x' ELSE CAST(n AS STRING) END AS n, concept, category, parent, ratio FROM {statement_template}
""",
    # A template as it may come: a total in two lines of another, one read before it is computed, one computed twice.
    "statement_template_odd": """
SELECT * FROM {statement_template} UNION ALL SELECT * FROM (VALUES
 (0,'Preview','T19',CAST(NULL AS STRING),'T19/T13'),(23,'Net new, again','T2','T13',NULL),(24,'P&L in preview','T18','T19',NULL),
 (25,'P&L in review','T18','T20',NULL),(26,'P&L in review, again','T18','T20',NULL),(27,'Units in review','A1','T20',NULL),(30,'Review','T20',NULL,'T20/A2')
) AS t(n, concept, category, parent, ratio)
""",
    "company_names": """
SELECT CASE r_regionkey WHEN 0 THEN 'BalanceAlpha' WHEN 1 THEN 'BalanceBeta' ELSE CONCAT('Balance', r_name) END AS code, CONCAT(r_name, ' MOTOR') AS company FROM {region}
""",
    "category_raw": """
SELECT CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_brand END AS identifier, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_type END AS name FROM {part}
""",
    "dim_company": """
SELECT r_regionkey AS code, r_name AS company FROM {region}
""",
    "dim_time": """
SELECT DISTINCT 1990 + o_orderkey % 41 AS year FROM {orders}
""",
}

FIXTURE_DEPS: dict[str, tuple[str, ...]] = {
    "sales_orders": ("orders", "customer", "nation"),
    "sales_orders_dirty": ("sales_orders",),
    "vehicle_stock": ("lineitem",),
    "ledger": ("lineitem", "supplier", "nation", "region"),
    "ledger_raw": ("lineitem", "supplier", "nation", "region"),
    "budget_raw": ("orders", "customer", "nation"),
    "statement_template": (),
    "template_raw": ("statement_template",),
    "statement_template_odd": ("statement_template",),
    "company_names": ("region",),
    "category_raw": ("part",),
    "dim_company": ("region",),
    "dim_time": ("orders",),
}


def duckdb_cte(names: list[str] | tuple[str, ...], recursive: bool = False) -> str:
    """``WITH a AS (...), b AS (...)`` for the oracle, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in FIXTURE_DEPS[name]:
            if dep in FIXTURE_SQL:
                visit(dep)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    plain = {t: t for t in BASE_TABLES + tuple(FIXTURE_SQL)}
    parts = [f"{name} AS ({FIXTURE_SQL[name].format(**plain).strip()})" for name in order]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


_SHARED: dict[tuple, "Tables"] = {}


class Tables:
    """Lazy access to the driver tables of one directory and the fixtures on them.

    ``Tables(spark, "/root/testdata/sf0.01").sales_orders`` is a DataFrame; the
    Parquet files are read with column pruning and filter pushdown by Spark.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    @classmethod
    def shared(cls, spark: SparkSession, sf_dir: str) -> "Tables":
        """One instance per session and directory, so queries over the same
        read-only inputs share the file listing, footers and analysed fixture
        plans (plan objects only; no data is cached)."""
        key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
        inst = _SHARED.get(key)
        if inst is None or inst.spark is not spark:
            for old in [k for k, t in _SHARED.items() if t.spark is not spark]:
                del _SHARED[old]  # of sessions that have ended
            inst = _SHARED[key] = cls(spark, sf_dir)
        return inst

    def base(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]

    def fixture(self, name: str) -> DataFrame:
        if name not in self._cache:
            deps = {d: (self.fixture(d) if d in FIXTURE_SQL else self.base(d)) for d in FIXTURE_DEPS[name]}
            self._cache[name] = self.spark.sql(FIXTURE_SQL[name], **deps)
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in FIXTURE_SQL:
            return self.fixture(name)
        if name in BASE_TABLES:
            return self.base(name)
        raise AttributeError(name)

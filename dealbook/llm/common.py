"""Helpers shared by the operators: scratch tables and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealbook.session import scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    The files cut the lineage: later passes and retried tasks read them and do
    not repeat the work. A page ends at about 1 MB also where rows are wide:
    the codec keeps direct memory of the largest page, and Parquet by itself
    first looks at a page's size after 100 rows.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.options(**PAGES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows after which the writer looks at the size of a page, at least and at most.
PAGES = {"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 100}
#: Rows and bytes that go to a Python task at a time, and rows that a Parquet scan decodes at a time: whole texts are long.
BATCH_ROWS, BATCH_BYTES, SCAN_ROWS = 2000, 4 << 20, 512


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches (BATCH_ROWS, BATCH_BYTES) and Parquet vectors (SCAN_ROWS).

    So a task holds few whole texts, or rows of packed values, at once. Lower
    bounds that the session has as plain numbers stay.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
                      ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
                      ("spark.sql.parquet.columnarReaderBatchSize", SCAN_ROWS)):
        now = spark.conf.get(key).removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, most)


def _edge_digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    Returns (node, component) for every node that has an edge to another;
    component is the smallest node of its group. Each round keeps at most as
    many edges as it got, all steps are equi-joins and aggregations with a
    partial step, and every round is written to the shared folder, so neither
    a hub nor the lineage grows. A round that changes no edge ends it.
    """
    edges = (edges.select(F.col(left).alias("a"), F.col(right).alias("b"))
             .where("a is not null and b is not null and a <> b")
             .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    edges = written(edges, "cc")
    before = _edge_digest(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u and v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Nodes with larger neighbours only keep an edge to their own minimum through `large`.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct())
        edges = written(small, "cc")
        after = _edge_digest(edges)
        if after == before:
            break
        before = after
    roots = edges.groupBy("u").agg(F.min("v").alias("component"))
    return (roots.select(F.col("u").alias("node"), "component")
            .unionByName(roots.select(F.col("component").alias("node"), "component").distinct()))

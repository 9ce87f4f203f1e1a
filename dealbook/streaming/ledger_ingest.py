"""Exactly-once ledger load from a landing folder (S3 + E1 as a stream).

New monthly ledger files dropped into the landing folder are picked up by
the file source, transformed with ``transform_ledger`` and appended to the
ledger table. The checkpoint (in the shared ``spark.checkpoint.dir``) records
which files were processed, so a restarted or re-run job, or one that lost
executors mid-batch, neither skips nor duplicates a file. With
``available_now`` the query processes everything landed so far and stops,
which suits a scheduled load.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from dealbook.plans.etl import transform_ledger
from dealbook.session import ensure_checkpoint_dir, scratch_dir
from dealbook.sources.landing import _LANDING_EXT, REJECT, adopt_lines, line_columns, read_landed_csv


def start_ledger_ingest(spark: SparkSession, landing: str, table: str, schema: StructType | str,
                        fmt: str = "parquet", company_names: dict[str, str] | None = None,
                        checkpoint: str | None = None, available_now: bool = True,
                        max_files_per_trigger: int = 1000) -> StreamingQuery:
    """Start the ingest query; the caller waits with ``awaitTermination()``.

    CSV files go by their own headers: each micro-batch is adopted
    (``sources.landing``) and written to a folder of its own (``batch=...``),
    which a batch that runs again overwrites; rows that do not fit are stored
    with ``quarantined`` true and their text in ``_reject``.
    """
    # One checkpoint per pair of landing folder and table.
    own = hashlib.sha256(f"{landing}\n{table}".encode()).hexdigest()[:16]
    checkpoint = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledger_ingest-{own}"
    if fmt == "csv":
        return _csv_ingest(spark, landing, table, schema, company_names, checkpoint, available_now,
                           max_files_per_trigger)
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.load(landing).withColumn(
        "source_name", F.regexp_replace(F.col("_metadata.file_name"), _LANDING_EXT, ""))
    ledger = transform_ledger(raw, company_names)
    # Partitioned by year: report filters on a year read only that folder.
    writer = (ledger.writeStream.format("parquet").outputMode("append").partitionBy("year")
              .option("path", table).option("checkpointLocation", checkpoint))
    return _start(writer, available_now)


def _start(writer, available_now: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def _csv_ingest(spark, landing, table, schema, company_names, checkpoint, available_now, max_files) -> StreamingQuery:
    lines = (spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(landing)
             .select(*line_columns()))

    def load(batch, number: int) -> None:
        session = batch.sparkSession
        rows = read_landed_csv(session, adopt_lines(batch, scratch_dir(session, "adopted")), schema)
        ledger = transform_ledger(rows, company_names).withColumn("quarantined", F.col(REJECT).isNotNull())
        ledger.write.mode("overwrite").partitionBy("quarantined", "year").parquet(f"{table}/batch={number}")

    return _start(lines.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint), available_now)

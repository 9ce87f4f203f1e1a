"""Bounds on what a task holds of wide rows: pages of stored tables, batches for Python."""

import glob

import numpy as np
import pandas as pd

from dealbook.llm import common


def _wide(spark, n: int):
    """n rows of 300 kB that do not compress."""
    def rows(batches):
        for pdf in batches:
            for i in pdf["id"]:
                yield pd.DataFrame({"id": [i], "b": [np.random.default_rng(int(i)).bytes(300_000)]})

    return spark.range(0, n, 1, 1).mapInPandas(rows, "id long, b binary")


def _pages(spark, path: str) -> list[int]:
    """Compressed sizes of all pages of a stored table."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    sizes = []
    for f in glob.glob(f"{path}/part-*"):
        file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(f), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
        for block in reader.getFooter().getBlocks():
            for column in block.getColumns():
                index = reader.readOffsetIndex(column)
                sizes += [index.getCompressedPageSize(i) for i in range(index.getPageCount())]
        reader.close()
    return sizes


def test_pages_of_wide_rows_stay_small(spark):
    df = common.written(_wide(spark, 120), "wide")
    sizes = _pages(spark, df.inputFiles()[0].removeprefix("file://").rpartition("/")[0])
    assert sum(sizes) > 36_000_000 and max(sizes) < 2_500_000  # before: a page of 30 MB
    assert df.selectExpr("count(distinct id)", "sum(length(b))").first()[:] == (120, 36_000_000)


def test_batches_of_wide_rows_stay_small(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch",
            "spark.sql.parquet.columnarReaderBatchSize")
    before = {k: spark.conf.get(k) for k in keys}

    def held(batches):
        for pdf in batches:
            yield pd.DataFrame({"rows": [len(pdf)], "size": [pdf["b"].str.len().sum()]})

    try:
        for k in keys:
            spark.conf.unset(k)
        common.small_batches(spark)
        assert [spark.conf.get(k) for k in keys] == [
            str(x) for x in (common.BATCH_ROWS, common.BATCH_BYTES, common.SCAN_ROWS)]
        found = common.written(_wide(spark, 40), "wide").coalesce(1).mapInPandas(held, "rows long, size long").collect()
        assert sum(r["rows"] for r in found) == 40
        assert max(r["size"] for r in found) <= common.BATCH_BYTES + 300_000  # before: 12 MB at once
        spark.conf.set(keys[1], "1000")
        common.small_batches(spark)
        assert spark.conf.get(keys[1]) == "1000"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

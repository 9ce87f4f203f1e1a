"""Versioned tables: a replace is written aside and becomes current by one commit.

A table folder holds one folder per version and ``_commits`` with one small
JSON file per commit, numbered upwards. A commit names the folders that make up
the table, its row counts and its schema; readers take the highest commit. So a
replace that fails on the way leaves the table as it was, and readers that have
begun keep their files: the version before the current one stays.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_COMMITS = "_commits"


def _fs(spark: SparkSession, path: str):
    """Hadoop file system and path object, so any store that Spark writes to works."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return bool(fs.exists(at))


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it does not exist."""
    fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _commit_numbers(spark: SparkSession, path: str) -> list[int]:
    return [int(n[:-5]) for n in names_in(spark, f"{path}/{_COMMITS}") if n.endswith(".json") and n[:-5].isdigit()]


def _commit(spark: SparkSession, path: str, number: int) -> dict | None:
    fs, at = _fs(spark, f"{path}/{_COMMITS}/{number:012d}.json")
    if not fs.exists(at):
        return None
    try:
        return json.loads(read_bytes(spark, f"{path}/{_COMMITS}/{number:012d}.json"))
    except ValueError:
        return None  # its writer was lost half-way: it never became a commit


def current(spark: SparkSession, path: str) -> dict | None:
    """The commit that readers see: number, folders, schema; None before the first."""
    for number in reversed(_commit_numbers(spark, path)):
        found = _commit(spark, path, number)
        if found:
            return found | {"number": number}
    return None


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """The content of a small file."""
    fs, at = _fs(spark, path)
    source = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source))
    finally:
        source.close()


def size_of(spark: SparkSession, path: str) -> int:
    fs, at = _fs(spark, path)
    return fs.getFileStatus(at).getLen()


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small new file; fails if it exists."""
    fs, at = _fs(spark, path)
    out = fs.create(at, False)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def _write_commit(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """Fails if the commit exists: of two writers from one version the second is refused."""
    write_bytes(spark, f"{path}/{_COMMITS}/{number:012d}.json", json.dumps(content).encode())


def _partition_folders(spark: SparkSession, root: str, depth: int) -> list[str]:
    """Partition folders of a version, relative to it."""
    found = [""]
    for _ in range(depth):
        found = [f"{f}/{n}".lstrip("/") for f in found for n in names_in(spark, f"{root}/{f}".rstrip("/")) if "=" in n]
    return found


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  replace_partitions_only: bool = False) -> int:
    """Create or replace a table (or only the partitions present in ``df``); returns the table's row count.

    The rows are counted from the written files, before the commit.
    """
    spark = df.sparkSession
    head = current(spark, path)
    numbers = _commit_numbers(spark, path)
    number = (numbers[-1] if numbers else 0) + 1
    version = f"v{number:012d}-{uuid.uuid4().hex[:8]}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/{version}")
    folders = _partition_folders(spark, f"{path}/{version}", len(partition_by or []))
    kept = {}
    if partition_by and replace_partitions_only and head:
        kept = {f: v for f, v in head["folders"].items() if f not in folders}
    live = kept | dict.fromkeys(folders, version)
    total = _read(spark, path, df.schema, live).count()
    content = {"folders": live, "rows": total, "schema": df.schema.jsonValue()}
    _write_commit(spark, path, number, content)
    _drop_unused(spark, path, number)
    return total


def _drop_unused(spark: SparkSession, path: str, number: int) -> None:
    """Deletes what the commit before the previous one used and no later one does."""
    old, *later = [_commit(spark, path, n) or {"folders": {}} for n in (number - 2, number - 1, number)]
    live = {v for c in later for v in c["folders"].values()}
    for version in set(old["folders"].values()) - live:
        fs, at = _fs(spark, f"{path}/{version}")
        fs.delete(at, True)


def _read(spark: SparkSession, path: str, schema: StructType, folders: dict[str, str]) -> DataFrame:
    """The rows of the given folders (each under its version)."""
    if not folders:
        return spark.createDataFrame([], schema)
    out = None
    for version in sorted(set(folders.values())):
        root = f"{path}/{version}"
        own = [f"{root}/{f}".rstrip("/") for f, v in sorted(folders.items()) if v == version]
        df = spark.read.schema(schema).option("basePath", root).parquet(*own)
        out = df if out is None else out.unionByName(df)
    return out.select(*[f.name for f in schema.fields])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table written by ``replace_table``."""
    head = current(spark, path)
    if head is None:
        raise ValueError(f"no table has been committed in {path}")
    return _read(spark, path, StructType.fromJson(head["schema"]), head["folders"])

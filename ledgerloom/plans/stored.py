"""Tables in the folder that the cluster shares: computed once, lineage cut."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """A folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``; where that is unset and everything runs in
    one process, as in tests, the warehouse folder serves.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("on a cluster spark.checkpoint.dir has to name a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/ledgerloom-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A lost executor costs only the tasks that were running on it, since what is
    written no longer depends on shuffle files.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    for made in _trackers:
        made.append(table)
    return table


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like ``stored``, cut into buckets of a key and sorted by it, so that joins and sums by the key need no exchange of this table."""
    spark = df.sparkSession
    table_name = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_root(spark)}/{table_name}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table_name)
    table = spark.table(table_name)
    table.stored_at, table.named = path, table_name
    for made in _trackers:
        made.append(table)
    return table


_trackers: list[list[DataFrame]] = []


@contextmanager
def tracked() -> Iterator[list[DataFrame]]:
    """A list that gets every table stored within the block."""
    made: list[DataFrame] = []
    _trackers.append(made)
    try:
        yield made
    finally:
        _trackers[:] = [m for m in _trackers if m is not made]


def _path(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, where: str) -> None:
    """Delete a file or folder, if it is there."""
    path, system = _path(spark, where)
    system.delete(path, True)


def exists(spark: SparkSession, where: str) -> bool:
    path, system = _path(spark, where)
    return system.exists(path)


def move(spark: SparkSession, where: str, to: str) -> None:
    """Rename a file or folder; nothing may stand at the new name."""
    (path, system), (target, _) = _path(spark, where), _path(spark, to)
    if not system.rename(path, target):
        raise OSError(f"{where} could not be renamed to {to}")


def discard(*tables: DataFrame) -> None:
    """Delete stored tables from which nothing is read any more."""
    for table in tables:
        if named := getattr(table, "named", None):
            table.sparkSession.sql(f"DROP TABLE IF EXISTS {named}")
        delete(table.sparkSession, table.stored_at)


def discard_unread(spark: SparkSession, tables: list[DataFrame], reader: DataFrame) -> list[DataFrame]:
    """Delete those of the stored tables that ``reader`` doesn't read; returns the others. Tables of another application are left out."""
    root = shared_root(spark)
    own = [t for t in tables if t.stored_at.startswith(root)]
    read = reader.inputFiles() if own else []
    kept = []
    for table in own:
        name = table.stored_at.rpartition("/")[2]  # no other folder has it
        if any(name in f for f in read):
            kept.append(table)
        else:
            delete(spark, table.stored_at)
    return kept


def release(spark: SparkSession) -> None:
    """Delete this application's stored tables, once no result of it is read any more."""
    delete(spark, shared_root(spark))

"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
#: Paths of the staged tables, by scope, the innermost last.
_SCOPES: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs locally."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _LOCAL[0]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files: later steps don't recompute it, and an executor that is lost takes nothing with it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder in buckets of ``column``, as a table of a fresh name, which is given too: a join on that column leaves its rows where they are."""
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(df.sparkSession)}/{table}"
    df.write.bucketBy(buckets, column).option("path", path).saveAsTable(table)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return df.sparkSession.table(table), table


def drop_bucketed(spark: SparkSession, table: str) -> None:
    """Drop such a table and delete its files."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    _delete(spark, f"{shared_folder(spark)}/{table}")


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            _delete(table.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes what was staged inside it once its work is done, but for tables passed to the function that it gives; on an error all stays."""
    made: list[str] = []
    kept: set[str] = set()
    _SCOPES.append(made)

    def keep(table: DataFrame) -> DataFrame:
        kept.update(f.rsplit("/", 1)[0] for f in table.inputFiles())
        return table

    try:
        yield keep
    except BaseException:
        _SCOPES.pop()
        raise
    _SCOPES.pop()
    names = {x.rsplit("/", 1)[1] for x in kept}
    for path in made:
        if path.rsplit("/", 1)[1] not in names:
            _delete(spark, path)
        elif _SCOPES:
            _SCOPES[-1].append(path)

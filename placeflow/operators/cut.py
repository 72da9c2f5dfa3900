"""Lineage cuts for loops: tables in the folder that driver and executors share, deleted when the loop is over.

The last table of a loop is its result and stays: within another loop until that one is over, else until release() or for good.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that a join may send to every task by way of the driver.
FEW = 50_000

_LOCAL: list[str] = []
#: Tables that the loop around the present one is to delete; results of outermost loops.
_OUTER: ContextVar[list[str] | None] = ContextVar("outer", default=None)
_RESULTS: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where unset, a cluster's warehouse if machines share it, or a temporary folder of a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if "://" not in warehouse or warehouse.startswith("file:"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        return warehouse.rstrip("/") + "/_rounds"
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="spark-rounds-"))
    return _LOCAL[0]


@contextmanager
def rounds(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes a frame and reads it back. At the end all tables but the last are deleted: the last is the result."""
    made: list[str] = []
    outer = _OUTER.get()
    token = _OUTER.set(made)

    def cut(df: DataFrame) -> DataFrame:
        path = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
        df.write.parquet(path)
        made.append(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield cut
    finally:
        _OUTER.reset(token)
        _delete(spark, made[:-1])
        (_RESULTS if outer is None else outer).extend(made[-1:])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in map(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Deletes the results of all loops so far, once what reads them is written."""
    paths, _RESULTS[:] = list(_RESULTS), []
    _delete(spark, paths)


def merged(df: DataFrame) -> DataFrame:
    """df as one side of a join that sorts and merges, whatever Spark takes its size for: nothing of it passes the driver."""
    return df.hint("merge")


def side(df: DataFrame) -> DataFrame:
    """A written table as one side of a join: sent to all tasks if it has few rows, so what passes the driver has a bound."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else merged(df)

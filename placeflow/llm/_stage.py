"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

_LOCAL_BASE: list[str] = []
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)
#: Catalyst's size for what it knows nothing of is the largest long.
_UNKNOWN = 1 << 62
#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where unset, a cluster's warehouse if machines share it, or a temporary folder of a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if "://" not in warehouse or warehouse.startswith("file:"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        return warehouse.rstrip("/") + "/_stages"
    if not _LOCAL_BASE:
        _LOCAL_BASE.append(tempfile.mkdtemp(prefix="spark-stages-"))
    return _LOCAL_BASE[0]


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of a batch for Python to BATCH_BYTES, so that long texts or packed rows don't fill a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, str(BATCH_BYTES))


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Notes the tables that are staged inside; delete() them once the results that read them are written."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)


def delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def beside(name: str, column: DataType, more: str) -> StructType:
    """A schema of one column, whatever its fields are called, and more, as DDL."""
    return StructType([StructField(name, column), *StructType.fromDDL(more)])


def input_partitions(df: DataFrame, bytes_each: int, least: int = 1) -> int:
    """Partitions that hold about bytes_each of df's input. Catalyst's estimate from file sizes, so no job runs; texts are summed
    where it knows none (frames from Python objects or RDDs)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= _UNKNOWN:
        size = df.select(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    return max(least, min(1_000_000, -(-size // bytes_each)))

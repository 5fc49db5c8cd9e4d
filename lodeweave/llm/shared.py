"""What the operators of this subpackage share: tables in the cluster's shared folder, task ids, CRCs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which every executor sees; only where that is unset (local tests), a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lodeweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Folders of the tables that the innermost ``scratch`` deletes at its end.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def free(spark: SparkSession) -> None:
    """Lets the driver's JVM drop the plans, broadcasts and shuffles of rounds that are done. Spark deletes their blocks and files once they are collected, and by itself that may be much later."""
    spark._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stored`` writes inside are deleted at the end, but for those it is told to keep."""
    token = _SCRATCH.set([])
    try:
        yield
    finally:
        for path in _SCRATCH.get():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        _SCRATCH.reset(token)
        free(spark)


def stored(df: DataFrame, name: str, level: int = 3, keep: bool = False, short: bool = False) -> DataFrame:
    """``df`` written once as Parquet, compressed at a Zstandard level, in the shared folder and read again.

    This cuts lineage: what follows reads files that outlive any executor, and a task that runs again reads the same rows. A ``short`` table, one whose
    rows are ids and counts, is written by four tasks for each core at most, not by as many as there are shuffle partitions.
    """
    path = shared_path(df.sparkSession, name)
    if short:
        df = df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)
    if not keep and (mine := _SCRATCH.get()) is not None:
        mine.append(path)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partition_id() -> int:
    return TaskContext.get().partitionId()


def table(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


#: Ids (8 bytes each) that are broadcast at most, to pick or drop rows; more are joined by a shuffle.
MOST_BROADCAST = 1 << 20


def _bounded(ids: DataFrame, on: str) -> DataFrame:
    ids = ids.toDF(on).distinct()
    return F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids


def picked(rows: DataFrame, ids: DataFrame, on: str = "doc_id") -> DataFrame:
    """The rows whose column ``on`` is one of ``ids``' only column."""
    return rows.join(_bounded(ids, on), on, "left_semi")


def without(rows: DataFrame, ids: DataFrame, on: str = "doc_id") -> DataFrame:
    """The rows whose column ``on`` is none of ``ids``' only column."""
    return rows.join(_bounded(ids, on), on, "left_anti")

"""Tables in the cluster's shared folder, which cut the lineage of iterative operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which every executor sees; only in local sessions, where that may be unset, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lodeweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written once as Parquet and read again; with ``by``, rows of different values of that column lie apart, so that those of one are read alone."""
    path = shared_path(df.sparkSession, name)
    (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
    found._is_stored = True
    return found


def once(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` as a stored table, which it may be already."""
    return df if getattr(df, "_is_stored", False) else stored(df, name, by)


@contextmanager
def meeting_by(spark: SparkSession) -> Iterator[None]:
    """Joins that run within it leave rows where a part of their keys has put them: rows dealt out by file meet others of their file without moving again."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)

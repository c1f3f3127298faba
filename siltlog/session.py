"""Session settings the library relies on and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def utc_session(spark: SparkSession) -> SparkSession:
    """Log times carry no zone, so every bucket and label is computed in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting for what is run inside, and what it was before afterwards."""
    before = spark.conf.getAll.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def working_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="siltlog-"))
    return spark.sparkContext.getCheckpointDir()


def working_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table below the shared folder."""
    return f"{working_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_WRITTEN: dict[str, list[str]] = {}


def release_later(spark: SparkSession, *paths: str) -> None:
    """Let :func:`release` delete folders that are no longer needed then."""
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).extend(paths)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts lineage durably and gives the optimizer the real size, so that joins
    against the result are broadcast only when it is below the threshold. Results
    read these tables, so they stay until :func:`release` is called.
    """
    path = working_path(df.sparkSession, name)
    release_later(df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the working tables of this application, once no result needs them."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove(spark, path)
    return len(paths)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder this library has written, on whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only after counting that ``df`` has at most ``max_rows``."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df

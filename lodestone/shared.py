"""The folder that driver and executors share, and cutting lineage there."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


#: Whether shuffle files go when their query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI; one without a scheme belongs to the default file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return "file://" + found[5:] if found.startswith("file:/") and not found.startswith("file://") else found


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where that is unset, a local folder in local mode and an error on a cluster."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return qualified(spark, base).rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def tidy(spark: SparkSession, **more: str) -> Iterator[None]:
    """While it holds, Spark may delete the shuffle files of a write when all is written, as nothing reads them again.

    ``more`` are other settings for the while, their dots written as two underscores.
    """
    wanted = {CLEANUP: "true"} | {k.replace("__", "."): v for k, v in more.items()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, what: str = "cut", path: str | None = None, **options: str) -> DataFrame:
    """Write to the shared folder (to ``path``, a new one by default) and read back: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = path or new_folder(spark, what)
    with tidy(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``new_folder`` named, when nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

"""Tables between jobs and cut lineage, in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from functools import cache

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="terrane-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or that of setCheckpointDir(); on one machine a temporary one where both are unset. RuntimeError on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _own_dir()
    return named.rstrip("/")


def _remove(path: str) -> None:
    """Delete a folder of any file system, if the JVM still runs."""
    try:
        jvm = SparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)
    except Exception:  # the process ends; what is left is only space
        pass


@cache
def _run_dir(base: str, application: str) -> str:
    path = f"{base}/terrane-{application}"
    atexit.register(_remove, path)
    return path


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it goes when the driver ends, as no table outlives its session."""
    return _run_dir(shared_dir(spark), spark.sparkContext.applicationId)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet in the shared folder and read them: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Checkpointed rows."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def bucketed(df: DataFrame, column: str) -> tuple[DataFrame, Callable[[], None]]:
    """The rows in buckets by a column, in the shared folder, so that joins by it shuffle only the other side; and what deletes them."""
    spark = df.sparkSession
    name = f"terrane_{uuid.uuid4().hex}"
    path = f"{run_dir(spark)}/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, column).write.bucketBy(n, column).option("path", path).saveAsTable(name)

    def drop() -> None:
        spark.sql(f"drop table if exists {name}")
        _remove(path)

    return spark.table(name), drop


class Rewritten:
    """A table that is written anew again and again: what it was before is deleted, and so are the shuffle files behind it."""

    def __init__(self, name: str):
        self.name, self.path = name, None

    def write(self, df: DataFrame) -> DataFrame:
        spark, old = df.sparkSession, self.path
        self.path = f"{run_dir(spark)}/{self.name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        if old:
            _remove(old)
        spark.sparkContext._jvm.System.gc()  # the driver deletes the shuffle files of what is garbage, but collects it seldom
        return spark.read.schema(df.schema).parquet(self.path)

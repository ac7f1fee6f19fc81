"""Parquet tables of one directory, and intermediate tables in shared storage."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK = "/tmp/codeloom-checkpoints"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table `name` of a data directory (a file or a folder of files)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share for intermediate tables.

    A cluster names it in `spark.checkpoint.dir`. Only where that is unset and
    the master runs in one process (as in tests) a local folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{_LOCAL_FALLBACK}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a folder through Hadoop's file system API; absent is fine."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables written to shared storage to cut a lineage.

    Written files outlive lost executors, unlike cached or locally checkpointed
    blocks. `drop` frees a table that nothing reads any more; the rest goes when
    the Python process ends.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self._end)

    def cut(self, df: DataFrame, partitions: int | None = None) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count:04d}"
        (df.coalesce(partitions) if partitions else df).write.mode("overwrite").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, df: DataFrame) -> None:
        if path := getattr(df, "_scratch_path", None):
            delete_path(self.spark, path)

    def _end(self) -> None:
        try:
            delete_path(self.spark, self.base)
        except Exception:
            pass  # the session has ended before the process

"""Derived tables that are built once for a state of their sources and then only read.

A table belongs to a snapshot: the names, lengths and times of all source files of a
directory. It is written beside its final place and renamed there, so a reader
finds it whole or not at all, and of two builders one wins while both get the same
rows. When the sources change, the snapshot's name does, too, and what is asked for
next is built anew.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from codeloom.sources.tables import delete_path, shared_dir

#: Bytes of source that one bucket of a bucketed table stands for, and how many buckets there are at least and at most.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 256 << 20, 8, 8192


#: Schemas by path; a path belongs to one state of the sources, so what is under it does not change.
_SCHEMAS: dict[str, StructType] = {}


def read_once(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A parquet table whose schema is read from its files once a process. `name`: what does not change while the schema does not."""
    df = spark.read.schema(_SCHEMAS[name]).parquet(path) if name in _SCHEMAS else spark.read.parquet(path)
    _SCHEMAS[name] = df.schema
    return df


class Kept:
    """The kept tables of one data directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._configuration = spark.sparkContext._jsc.hadoopConfiguration()
        root = self._path(directory)
        fs = root.getFileSystem(self._configuration)
        seen, self.bytes = [], 0
        walk = fs.listFiles(root, True)
        while walk.hasNext():
            f = walk.next()
            seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
            self.bytes += f.getLen()
        digest = hashlib.sha256("\n".join([directory, *sorted(seen)]).encode()).hexdigest()[:24]
        self.home = f"{shared_dir(spark)}/kept/{hashlib.sha256(directory.encode()).hexdigest()[:16]}"
        self.base = f"{self.home}/{digest}"
        self._fs = self._path(self.base).getFileSystem(self._configuration)

    def prune(self) -> int:
        """Drops what was kept of former states of this directory, once nobody reads it any more; how many states that were."""
        home = self._path(self.home)
        if not self._fs.exists(home):
            return 0
        old = [f.getPath().toString() for f in self._fs.listStatus(home) if f.getPath().getName() != self.base.rsplit("/", 1)[1]]
        for path in old:
            delete_path(self.spark, path)
        return len(old)

    @property
    def buckets(self) -> int:
        return min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-self.bytes // BUCKET_BYTES)))

    def bucket(self, key) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def table(self, name: str, build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
        """A table, built if this snapshot does not have it yet. `by`: a column whose hash buckets become folders, sorted by it within, so that a lookup reads one folder and of it the row groups that may hold the key."""
        at = f"{self.base}/{name}"
        done = self._path(f"{at}/_SUCCESS")
        if not self._fs.exists(done):
            rows = build()
            temporary = f"{self.base}/_{name}-{uuid.uuid4().hex}"
            if by:
                rows = rows.withColumn("bucket", self.bucket(by)).repartition(self.buckets, "bucket").sortWithinPartitions("bucket", by)
                rows.write.partitionBy("bucket").parquet(temporary)
            else:
                rows.write.parquet(temporary)
            if not self._fs.rename(self._path(temporary), self._path(at)) or not self._fs.exists(done):
                delete_path(self.spark, temporary)
        return read_once(self.spark, at, at)

    def lookup(self, table: DataFrame, by: str, keys: list) -> DataFrame:
        """The rows of some keys: their buckets are a literal filter on the folders."""
        if not keys:
            return table.where("false")
        # constants are folded by the planner: this runs no job
        kind = dict(table.dtypes)[by]
        numbers = list(set(self.spark.sql("SELECT 1").select(*[self.bucket(F.lit(k).cast(kind)).alias(f"b{n}") for n, k in enumerate(keys)]).first()))
        return table.where(F.col("bucket").isin(numbers) & F.col(by).isin(keys))

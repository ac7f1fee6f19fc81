"""Tables as immutable versions under one folder, with atomically published pointers.

A version's files are written first, into a folder of their own name; then a
small pointer file named after the version's number is renamed into place. The
rename fails where another writer has published that number, so of two writers
that started from one version only one succeeds and the other hears of it. A
reader resolves the greatest pointer once and so sees one version whole,
whatever is published meanwhile; a writer that fails leaves no trace but files
that nothing points to.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.sources.tables import delete_path


class Conflict(RuntimeError):
    """Another writer has published meanwhile."""


class Versions:
    """Several tables that change together. `parts`: schema by name of the table."""

    def __init__(self, spark: SparkSession, path: str, parts: dict[str, str], keep: int = 2):
        self.spark, self.path, self.parts, self.keep = spark, path.rstrip("/"), parts, keep
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        at = self._path(self.path)
        if not self._fs.exists(at):
            return []
        return sorted(int(m[1]) for f in self._fs.listStatus(at) if (m := re.fullmatch(r"_current-(\d+)", f.getPath().getName())))

    def version(self) -> int:
        """The current version, 0 if none was ever published."""
        return max(self._pointers(), default=0)

    def _folder(self, version: int) -> str:
        stream = self._fs.open(self._path(f"{self.path}/_current-{version:012d}"))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read_part(self, part: str, version: int | None = None) -> DataFrame:
        """One version of a table, by default the current one; later publications do not change the result."""
        v = self.version() if version is None else version
        if not v:
            return self.spark.createDataFrame([], self.parts[part])
        return self.spark.read.schema(self.parts[part]).parquet(f"{self.path}/{self._folder(v)}/{part}")

    def stage_parts(self, tables: dict[str, DataFrame]) -> tuple[int, str]:
        """Writes what may become the next version: (its number, its folder). Parts left out are carried over."""
        v = self.version()
        folder = f"v={v + 1}-{uuid.uuid4().hex[:12]}"
        for part, schema in self.parts.items():
            rows = tables[part] if part in tables else self.read_part(part, v)
            fields = self.spark.createDataFrame([], schema).schema.fields
            rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]).write.mode("overwrite").parquet(f"{self.path}/{folder}/{part}")
        return v + 1, folder

    def publish(self, staged: tuple[int, str]) -> int:
        """Makes a staged version current by one atomic rename; versions older than `keep` are dropped."""
        version, folder = staged
        for part in self.parts:
            if not self._fs.exists(self._path(f"{self.path}/{folder}/{part}/_SUCCESS")):
                raise ValueError(f"{folder} is not complete")
        if version != self.version() + 1:
            raise Conflict(f"version {version} follows no longer on the current one")
        temporary = self._path(f"{self.path}/_next-{uuid.uuid4().hex}")
        out = self._fs.create(temporary, True)
        out.write(bytearray(folder, "ascii"))
        out.close()
        jvm = self.spark.sparkContext._jvm
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(temporary, self._path(f"{self.path}/_current-{version:012d}"), none)
        except Exception as e:
            self._fs.delete(temporary, False)
            if version <= self.version():
                raise Conflict(f"version {version} was published by another writer") from e
            raise
        for old in self._pointers():
            if old <= version - self.keep:
                delete_path(self.spark, f"{self.path}/{self._folder(old)}")
                delete_path(self.spark, f"{self.path}/_current-{old:012d}")
        return version


class VersionedTable(Versions):
    """A single table."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keep: int = 2):
        super().__init__(spark, path, {"rows": schema}, keep)

    def read(self, version: int | None = None) -> DataFrame:
        return self.read_part("rows", version)

    def stage(self, rows: DataFrame) -> tuple[int, str]:
        """Writes the next version without publishing it."""
        return self.stage_parts({"rows": rows})

    def replace(self, rows: DataFrame, key: str) -> int:
        """Copy-on-write: rows of the keys in `rows` are replaced, all others kept; the new version."""
        old = self.read()
        return self.publish(self.stage(old.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows.select(*old.columns))))

    def remove(self, keys: DataFrame, key: str) -> int:
        """Copy-on-write: rows of the given keys are dropped; the new version."""
        return self.publish(self.stage(self.read().join(keys.select(key).distinct(), key, "left_anti")))

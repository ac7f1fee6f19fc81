"""An index of a workspace kept as versions: built once, then refreshed by what has changed.

All parts change together: a version is published whole or not at all
(`sources.versions`). A refresh compares the files by path and hash, reads and
derives only what is new or changed, drops what hangs on files that are gone, and
takes the rest over. If any new or changed file cannot be read, nothing is
published.

Defined results: repeated rows count once; of several contents of a file the
greatest counts; an empty workspace is a valid version; the order of rows is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.functions.text import tokens
from codeloom.operators.store import nearest_owner
from codeloom.sources.tables import Scratch
from codeloom.sources.versions import Versions

PARTS = {
    "files": "id long, path string, size long, hash long, lang string, line_count int, is_generated boolean",
    "contents": "file_id long, content string",
    "symbols": "id long, file_id long, parent_id long, kind string, name string, ns string, container string, signature string, start_line int, end_line int",
    "postings": "token string, file_id long, tf long",
    "projects": "id long, key string, dir string, name string, lang string",
    "owners": "file_id long, project_id long",
    "meta": "key string, value string",
}


class Unreadable(RuntimeError):
    """A new or changed file has no content."""


def _only(df: DataFrame, ids: DataFrame, key: str = "file_id") -> DataFrame:
    return df.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_semi")


def _but(df: DataFrame, ids: DataFrame, key: str = "file_id") -> DataFrame:
    return df.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_anti")


class Index(Versions):
    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, PARTS)

    def _shaped(self, part: str, rows: DataFrame) -> DataFrame:
        return rows.select(*self.spark.createDataFrame([], PARTS[part]).columns)

    def build(self, files: DataFrame, contents: DataFrame, symbols: DataFrame, projects: DataFrame, meta: dict[str, str] | None = None) -> int:
        """The first version, or a new one drawn from everything."""
        texts = _texts(contents, files)
        return self.publish(self.stage_parts({
            "files": files.dropDuplicates(["id"]), "contents": texts, "symbols": _only(self._shaped("symbols", symbols), files).distinct(), "postings": _postings(texts),
            "projects": projects, "owners": _owners(files, projects), "meta": self._meta(meta),
        }))

    def refresh(self, files: DataFrame, contents: DataFrame, symbols: DataFrame, projects: DataFrame, meta: dict[str, str] | None = None) -> DataFrame:
        """(path, action) of every file: 'skip', 'replace', 'insert' or 'delete'; published as one new version if anything but skips is among them or projects have changed."""
        old = self.read_part("files")
        a = old.select(F.col("path").alias("o_path"), F.col("id").alias("o_id"), F.col("hash").alias("o_hash"))
        b = files.dropDuplicates(["id"]).select("path", "id", "hash")
        j = a.join(b, F.col("o_path") == F.col("path"), "full")
        action = F.when(F.col("o_path").isNull(), "insert").when(F.col("path").isNull(), "delete").when(F.col("o_hash") == F.col("hash"), "skip").otherwise("replace")
        acts = j.select(F.coalesce("path", "o_path").alias("path"), action.alias("action"), F.when(action != "skip", F.col("id")).alias("new_id"), F.when(action != "skip", F.col("o_id")).alias("old_id"))
        # written, as the old version may be dropped by later publications
        acts = Scratch(self.spark, "refresh").cut(acts)
        touched = acts.where("action in ('insert', 'replace')").select(F.col("new_id").alias("id"))
        gone = acts.where("action in ('delete', 'replace')").select(F.col("old_id").alias("id"))
        texts = _texts(contents, touched)
        if not touched.join(texts.select(F.col("file_id").alias("id")), "id", "left_anti").isEmpty():
            raise Unreadable("a new or changed file has no content; nothing was published")
        same_projects = self._shaped("projects", projects).exceptAll(self.read_part("projects")).isEmpty() and self.read_part("projects").exceptAll(self._shaped("projects", projects)).isEmpty()
        if touched.isEmpty() and gone.isEmpty() and same_projects and not meta:
            return acts.select("path", "action")
        fresh = files.dropDuplicates(["id"]).join(touched, "id", "left_semi")
        # files that were added belong to the nearest project as any other; only new projects can move the others
        owners = _but(self.read_part("owners"), gone).unionByName(_owners(fresh, projects)) if same_projects else _owners(files, projects)
        self.publish(self.stage_parts({
            "files": _but(old, gone, "id").unionByName(self._shaped("files", fresh)),
            "contents": _but(self.read_part("contents"), gone).unionByName(texts),
            "symbols": _but(self.read_part("symbols"), gone).unionByName(_only(self._shaped("symbols", symbols), touched).distinct()),
            "postings": _but(self.read_part("postings"), gone).unionByName(_postings(texts)),
            "projects": projects, "owners": owners, "meta": self._meta(meta),
        }))
        return acts.select("path", "action")

    def _meta(self, fresh: dict[str, str] | None) -> DataFrame:
        """The metadata with some keys set: what is new wins."""
        new = self.spark.createDataFrame(list((fresh or {}).items()), PARTS["meta"])
        return self.read_part("meta").join(new.select("key"), "key", "left_anti").unionByName(new)

    def copy_to(self, path: str) -> Index:
        """A consistent copy of the current version under another folder."""
        other = Index(self.spark, path)
        v = self.version()
        other.publish(other.stage_parts({part: self.read_part(part, v) for part in PARTS}))
        return other


def _texts(contents: DataFrame, ids: DataFrame) -> DataFrame:
    c = contents.where("content is not null").select("file_id", "content")
    return _only(c, ids).groupBy("file_id").agg(F.max("content").alias("content"))


def _postings(texts: DataFrame) -> DataFrame:
    return texts.select("file_id", F.explode(tokens("content")).alias("token")).groupBy("token", "file_id").agg(F.count("*").alias("tf"))


def _owners(files: DataFrame, projects: DataFrame) -> DataFrame:
    return nearest_owner(files.where(F.col("lang").isin("cs", "fs")), projects)

"""The store's derived tables: projects, edges, ownership, base types, lines, postings."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codeloom.functions.text import base_name, dir_name, fold, segments, tokens
from codeloom.operators.orphans import normal_path
from codeloom.sources.kept import Kept, read_once

# fixed values: kinds of symbols that are types, and names of configuration files that hold for all projects below them
TYPE_KINDS = ("class", "interface", "struct", "record", "record_struct", "enum", "delegate", "union", "type", "exception")
CONFIG_NAMES = ("global.json", "nuget.config", "app.config", "web.config", "appsettings.json", "packages.config", "directory.build.props", "directory.build.targets", "directory.packages.props")


class Store:
    """The tables of one data directory; what is derived is built once for a state of the sources and kept (`sources.kept`)."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def raw(self, name: str) -> DataFrame:
        return read_once(self.spark, f"{self.kept.base}:{name}", f"{self.directory}/{name}.parquet")

    @cached_property
    def kept(self) -> Kept:
        return Kept(self.spark, self.directory)

    @cached_property
    def files(self) -> DataFrame:
        """Ids and paths are unique in this table."""
        return self.raw("files")

    @cached_property
    def contents(self) -> DataFrame:
        """(file_id, content), distinct, in buckets of the file's id: the one place where whole texts are moved."""
        return self.kept.table("contents", lambda: self.raw("file_contents").select("file_id", "content").distinct(), by="file_id")

    def contents_of(self, ids: DataFrame) -> DataFrame:
        """The texts of some files (file_id): joined on the bucket, too, so that only the folders that hold them are read."""
        few = ids.select("file_id", self.kept.bucket("file_id").alias("bucket")).distinct()
        return self.contents.join(few, ["bucket", "file_id"], "left_semi")

    @cached_property
    def symbols(self) -> DataFrame:
        """Of rows that share an id the smallest, by all columns."""

        def build() -> DataFrame:
            s = self.raw("symbols")
            rest = [c for c in s.columns if c != "id"]
            return s.groupBy("id").agg(F.min(F.struct(*rest)).alias("v")).select("id", "v.*")

        return self.kept.table("symbols", build)

    @cached_property
    def projects(self) -> DataFrame:
        """The latest live record of each project path."""

        def build() -> DataFrame:
            p = self.raw("parsed_projects").where("removed_at is null").withColumn("key", normal_path(F.col("rel_path")))
            latest = F.max(F.struct("parsed_at", "id", "rel_path", "name", "style", "lang", "tfms", "is_test", "load_status", "compile_globs", "project_ref_rel_paths")).alias("v")
            return p.groupBy("key").agg(latest).select("key", dir_name("key").alias("dir"), "v.*")

        return self.kept.table("projects", build)

    @cached_property
    def refs(self) -> DataFrame:
        """(from_id, to_id), distinct: references between live projects."""

        def build() -> DataFrame:
            ask = self.projects.select(F.col("id").alias("from_id"), F.explode("project_ref_rel_paths").alias("r")).where("r is not null").withColumn("to_key", normal_path(F.col("r")))
            to = self.projects.select(F.col("key").alias("k"), F.col("id").alias("to_id"))
            return ask.join(to, ask["to_key"] == to["k"]).select("from_id", "to_id").distinct()

        return self.kept.table("refs", build)

    @cached_property
    def named_refs(self) -> DataFrame:
        """(from_id, to_id, lang): edges recovered from package references by a project's name, one a language, never to the asking project."""

        def build() -> DataFrame:
            f = self.files.where(F.col("lang").isin("csproj", "fsproj")).select(F.col("id").alias("f_id"), fold("path").alias("f_path"))
            pk = self.contents_of(f.select(F.col("f_id").alias("file_id"))).join(f, F.col("file_id") == F.col("f_id")).select("f_path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r'<(?:PackageReference|Reference)\b[^>]*\bInclude\s*=\s*"([^",]*)'), F.lit(1)))).alias("package"))
            ask = pk.join(self.projects.select("key", F.col("id").alias("from_id")), F.col("f_path") == F.col("key")).select("from_id", fold(F.trim("package")).alias("package")).distinct()
            to = self.projects.select(F.col("id").alias("to_id"), fold("name").alias("to_name"), "lang")
            j = ask.join(to, (ask["package"] == to["to_name"]) & (ask["from_id"] != to["to_id"]))
            return j.groupBy("from_id", "package", "lang").agg(F.min("to_id").alias("to_id")).select("from_id", "to_id", "lang").distinct()

        return self.kept.table("named_refs", build)

    @cached_property
    def edges(self) -> DataFrame:
        """(from_id, to_id, kind): 'project' for a project reference, 'assembly' for one recovered by name; a pair that is both is a project reference."""
        both = self.refs.withColumn("kind", F.lit("project")).unionByName(self.named_refs.select("from_id", "to_id").withColumn("kind", F.lit("assembly")))
        return both.groupBy("from_id", "to_id").agg(F.max("kind").alias("kind"))

    @cached_property
    def owners(self) -> DataFrame:
        """(file_id, project_id): each source file belongs to the project of its language in the nearest directory above it."""
        return self.kept.table("owners", lambda: nearest_owner(self.files.where(F.col("lang").isin("cs", "fs")), self.projects))

    @cached_property
    def base_edges(self) -> DataFrame:
        """(base_name folded, base_arity, derived_id, file_id) from the base lists of type signatures."""

        def build() -> DataFrame:
            listed = F.regexp_extract("signature", r" : (.*)$", 1)
            each = F.explode(F.split(listed, r", ?(?![^<]*>)"))
            s = self.symbols.where(F.col("kind").isin(*TYPE_KINDS) & F.col("signature").contains(" : ")).select(F.col("id").alias("derived_id"), "file_id", each.alias("base"))
            name = fold(F.regexp_extract(F.regexp_replace(F.trim("base"), r"<.*$", ""), r"[^.]*$", 0))
            arity = F.when(F.col("base").contains("<"), F.length(F.regexp_replace("base", "[^,]", "")) + 1).otherwise(0)
            return s.select(name.alias("base_name"), arity.cast("int").alias("base_arity"), "derived_id", "file_id").where("base_name <> ''").distinct()

        return self.kept.table("base_edges", build)

    @cached_property
    def lines(self) -> DataFrame:
        """(file_id, line_no, line): texts by line, counted from 1."""
        return lines_of(self.contents)

    def lines_with(self, *needles: str) -> DataFrame:
        """Lines of the texts that hold all needles as they are; a substring test before the texts are cut spares most of the work."""
        c = self.contents
        for n in needles:
            c = c.where(F.col("content").contains(n))
        return lines_of(c)

    def lines_with_folded(self, *needles: str) -> DataFrame:
        """As `lines_with`, ASCII-folded."""
        c = self.contents
        for n in needles:
            c = c.where(F.lower("content").contains(n))
        return lines_of(c)

    @cached_property
    def postings(self) -> DataFrame:
        """(token, file_id, tf): how often each token stands in each file, in buckets of the token."""
        build = lambda: self.contents.select("file_id", F.explode(tokens("content")).alias("token")).groupBy("token", "file_id").agg(F.count("*").alias("tf"))
        return self.kept.table("postings", build, by="token")

    def postings_of(self, query: list[str]) -> DataFrame:
        """The postings of some tokens: only their buckets are read."""
        return self.kept.lookup(self.postings, "token", query).select("token", "file_id", "tf")

    @cached_property
    def lengths(self) -> DataFrame:
        """(file_id, dl): the number of tokens of each file."""
        return self.kept.table("lengths", lambda: self.postings.groupBy("file_id").agg(F.sum("tf").alias("dl")))

    @cached_property
    def corpus(self) -> DataFrame:
        """One row: the number of files with tokens and their mean length."""
        return self.kept.table("corpus", lambda: self.lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")))

    def texts_holding(self, query: list[str]) -> DataFrame:
        """The texts of the files that hold all tokens, by the postings."""
        hits = self.postings_of(query).groupBy("file_id").agg(F.count("*").alias("n")).where(F.col("n") == len(query))
        return self.contents_of(hits)

    @cached_property
    def configs(self) -> DataFrame:
        return self.files.where(fold(base_name("path")).isin(*CONFIG_NAMES)).select(F.col("id").alias("config_id"), F.col("path").alias("config_path"), fold(dir_name("path")).alias("config_dir"), fold(base_name("path")).alias("config_name"), "hash")


def lines_of(contents: DataFrame) -> DataFrame:
    cut = contents.select("file_id", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    return cut.select("file_id", (F.col("n") + 1).alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line"))


def ancestors(path_dir: Column) -> Column:
    """All directories from the root down to `path_dir`, the root ('') included, as an array."""
    parts = F.split(path_dir, "/")
    return F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, 1, n))))


def nearest_owner(files: DataFrame, projects: DataFrame) -> DataFrame:
    """(file_id, project_id): longest-directory-prefix join, an equi-join on exploded ancestor directories."""
    f = files.select(F.col("id").alias("file_id"), F.col("lang").alias("f_lang"), F.explode(ancestors(fold(dir_name("path")))).alias("above"))
    p = projects.select(F.col("id").alias("project_id"), "dir", F.col("lang").alias("p_lang"))
    j = f.join(p, (f["above"] == p["dir"]) & (f["f_lang"] == p["p_lang"]))
    best = F.max_by("project_id", F.struct(F.length("above"), -F.col("project_id"))).alias("project_id")
    return j.groupBy("file_id").agg(best)


def nearest_config(projects: DataFrame, configs: DataFrame) -> DataFrame:
    """(project_id, config_name, config_path): for each name the configuration in the nearest directory at or above a project."""
    p = projects.select(F.col("id").alias("project_id"), F.explode(ancestors(F.col("dir"))).alias("above"))
    j = p.join(configs, p["above"] == configs["config_dir"])
    return j.groupBy("project_id", "config_name").agg(F.max_by("config_path", F.struct(F.length("above"), "config_path")).alias("config_path"))


def first_segment(path: Column | str) -> Column:
    return segments(path)[0]


def ordinal_on_line(symbols: DataFrame) -> DataFrame:
    """Symbols with their place among those that start on the same line: a window, not a correlated count."""
    w = Window.partitionBy("file_id", "start_line").orderBy("id")
    return symbols.withColumn("ordinal", F.row_number().over(w) - 1)

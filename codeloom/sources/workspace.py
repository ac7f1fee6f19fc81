"""A workspace folder as tables: scan, decode, project and solution files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeloom.functions.text import EXCLUDED_DIRS, base_name, fold, has_segment
from codeloom.operators.store import CONFIG_NAMES

# fixed values: languages by extension
EXTENSIONS = {"cs": "cs", "csx": "cs", "fs": "fs", "fsi": "fs", "fsx": "fs", "md": "md", "sql": "sql", "csproj": "csproj", "fsproj": "fsproj", "sln": "sln", "slnx": "sln"}


def language(path: Column | str) -> Column:
    """A file's language by its name; null if it is not indexed."""
    ext = fold(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for e, lang in EXTENSIONS.items():
        out = F.when(ext == e, lang).otherwise(out)
    name = fold(base_name(path))
    return F.when(name.isin(*CONFIG_NAMES) | name.like("appsettings%.json"), "config").otherwise(out)


def scan(spark: SparkSession, root: str, excluded: tuple[str, ...] = EXCLUDED_DIRS) -> DataFrame:
    """(path, size, modified, lang, content, digest, line_count) of the indexed files below a folder.

    Paths are relative to the root; ids are left to the caller, who derives them
    from the order of paths so that they are the same on every run.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = root.rstrip("/").removeprefix("file:").lstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", ""), "^" + _quote(prefix) + "/?", "")
    files = raw.select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    kept = files.where(~has_segment("path", excluded, True)).withColumn("lang", language("path")).where("lang is not null")
    text = F.decode("content", "UTF-8")
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return kept.select("path", "size", "modified", "lang", text.alias("text"), F.sha2("content", 256).alias("digest"), lines.cast("int").alias("line_count"))


def _quote(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "/" else c for c in s)


def projects(files: DataFrame) -> DataFrame:
    """(path, sdk, frameworks, project_refs, packages, assembly_refs, compiles, removes, visible_to, is_test, load_status) of project files, attributes in any order; malformed ones are told, not dropped."""
    p = files.where(F.col("lang").isin("csproj", "fsproj"))
    one = lambda tag: F.regexp_extract("text", rf"<{tag}>\s*([^<]*?)\s*</{tag}>", 1)
    every = lambda tag, attribute="Include": F.regexp_extract_all("text", F.lit(rf'<{tag}\b[^>]*\b{attribute}\s*=\s*"([^"]*)"'), F.lit(1))
    whole = F.col("text").rlike(r"(?s)<Project\b.*</Project>\s*$") | F.col("text").rlike(r"(?s)<Project\b[^>]*/>\s*$")
    several = one("TargetFrameworks")
    # fixed values: packages that mark a test project
    tests = F.exists(every("PackageReference"), lambda x: fold(x).isin("microsoft.net.test.sdk", "xunit", "nunit", "mstest.testframework"))
    return p.select(
        "path", F.regexp_extract("text", r'<Project\b[^>]*\bSdk\s*=\s*"([^"]*)"', 1).alias("sdk"), F.when(several != "", several).otherwise(one("TargetFramework")).alias("frameworks"),
        every("ProjectReference").alias("project_refs"), every("PackageReference").alias("packages"), every("Reference").alias("assembly_refs"), every("Compile").alias("compiles"), every("Compile", "Remove").alias("removes"),
        every("InternalsVisibleTo").alias("visible_to"), tests.alias("is_test"), F.when(whole, "parsed").otherwise("failed:xml").alias("load_status"),
    )


def solutions(files: DataFrame) -> DataFrame:
    """(path, name, member) of solution files' entries."""
    s = files.where("lang = 'sln'").select("path", F.explode(F.regexp_extract_all("text", F.lit(r'Project\("[^"]*"\) = "[^"]*", "[^"]*"'), F.lit(0))).alias("x"))
    return s.select("path", F.regexp_extract("x", '= "([^"]*)"', 1).alias("name"), F.regexp_extract("x", ', "([^"]*)"', 1).alias("member"))


def solution_projects(texts: DataFrame) -> DataFrame:
    """(path, member) of solutions (path, name, text) in the format that their name tells: lines of text, XML, or a JSON filter; separators are `/`."""
    name = fold("name")
    lines = F.regexp_extract_all("text", F.lit(r'Project\("[^"]*"\)\s*=\s*"[^"]*",\s*"([^"]*)"'), F.lit(1))
    xml = F.regexp_extract_all("text", F.lit(r'<Project\b[^>]*\bPath\s*=\s*"([^"]*)"'), F.lit(1))
    json = F.from_json("text", "solution struct<projects: array<string>>")["solution"]["projects"]
    members = F.when(name.endswith(".slnx"), xml).when(name.endswith(".slnf"), F.coalesce(json, F.array().cast("array<string>"))).otherwise(lines)
    m = texts.select("path", F.explode(members).alias("m")).where("m is not null")
    return m.where(fold("m").endswith("proj")).select("path", F.replace("m", F.lit("\\"), F.lit("/")).alias("member")).distinct()

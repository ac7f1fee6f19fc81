import re

import pytest
from pyspark.sql import functions as F

from codeloom.functions import text as X


@pytest.mark.parametrize("s, want", [("Mode4", "Mode 4"), ("AsyncAPI", "Async API"), ("IPartnerFramework2", "IPartner Framework 2"), ("plain", None), ("Mode 4", None)])
def test_split(s, want):
    assert X.split_variant(s) == want


@pytest.mark.parametrize("s, want", [("Mode 4", "Mode4"), ("Mode\t4", "Mode4"), ("a b c", "abc"), ("single", None)])
def test_join(s, want):
    assert X.join_variant(s) == want


@pytest.mark.parametrize("pattern, want", [(r"\bpublic\b", ["public"]), (r"\bCreate\b", ["create"]), (r"\bpublic\b\s+\bstatic\b", ["public", "static"]), (r"public\s+static", []), ("foo bar", []), (r"Get\w+Client", []), ("foo.*bar", []), ("(foo|bar)baz", []), ("public|private", []), ("abc?def", []), (r"\bab\b", []), (r"x \bfoo\b|y", [])])
def test_required_literals(pattern, want):
    assert X.required_literals(pattern) == want


@pytest.mark.parametrize("path, glob, want", [("a/b/C.cs", "a/**/*.cs", True), ("a/C.cs", "a/**/*.cs", True), ("a/b/C.cs", "a/*.cs", False), ("a/Cx.cs", "a/C?.cs", True), ("A/c.CS", "a/*.cs", True)])
def test_build_glob(path, glob, want):
    assert bool(re.match(X.build_glob_regex(glob), X.fold_text(path))) == want


def test_columns(spark):
    df = spark.createDataFrame([("a/b/C.cs", "x Foo_1 É é"), ("C.cs", None), ("vendor/x.g.cs", "// <auto-generated/>"), (None, "y")], "path string, content string")
    crossing = df.where(X.path_filter(F.col("path"), "a/*.cs")).collect()
    assert [r["path"] for r in crossing] == ["a/b/C.cs"]  # a query glob's star crosses `/`
    assert df.where(X.path_filter(F.col("path"), "**/C.cs", ("a/*",))).count() == 1
    assert df.select(X.fold(F.lit("AÉZ")).alias("x")).first()["x"] == "aÉz"
    assert df.select(X.tokens("content").alias("x")).first()["x"] == ["x", "foo_1", "É", "é"]
    assert [r["x"] for r in df.select(X.looks_generated("path", "content").alias("x")).collect()] == [False, False, True, False]
    assert [r["x"] for r in df.select(X.has_segment("path", ("vendor",), True).alias("x")).collect()] == [False, False, True, None]
    assert df.select(X.snippet(F.lit("a" * 300 + "  ")).alias("x")).first()["x"] == "a" * 240 + "…"

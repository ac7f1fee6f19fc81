import datetime as dt
import posixpath

import pytest
from pyspark.sql import functions as F

from codeloom.operators.orphans import bloom_filter, may_contain, normal_path, orphan_report, orphans

P = "id long, rel_path string, project_ref_rel_paths array<string>, parsed_at timestamp, removed_at timestamp, key string, block long"
S = "id long, rel_path string, project_rel_paths array<string>, parsed_at timestamp, state string"
DAY = lambda n: dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


@pytest.mark.parametrize("path", ["a/b", "./A//b/", " a\\b ", "a/x/../b", "a/./b/.", "../a", "a/../../b", "a/b/..", " a/b\t", "", "..", "x/y/z/../../../a/b"])
def test_normal_path(spark, path):
    got = spark.createDataFrame([(path,)], "p string").select(normal_path(F.col("p")).alias("k")).first()["k"]
    want = posixpath.normpath(path.strip().lower().replace("\\", "/").strip("/") or ".")
    assert got == ("" if want == "." else want)


def test_states(spark):
    t = (None, None)
    projects = [
        (1, "a/A.csproj", ["b/B.csproj", "B\\b.CSPROJ", "gone/G.csproj", "late/L.csproj", "nope/N.csproj", None, " ", "nope/N.csproj"], DAY(10), None, *t),
        (1, "a/A.csproj", ["b/B.csproj", "B\\b.CSPROJ", "gone/G.csproj", "late/L.csproj", "nope/N.csproj", None, " ", "nope/N.csproj"], DAY(10), None, *t),
        (2, "b/B.csproj", None, DAY(1), None, *t),
        (3, "gone/G.csproj", ["a/A.csproj"], DAY(1), DAY(2), *t),
        (4, "late/L.csproj", [], DAY(40), None, *t),
        (5, None, ["x"], None, None, *t),
    ]
    solutions = [(1, "s.sln", ["./a/x/../A.csproj", "zzz"], DAY(31), "x"), (2, "t.sln", None, None, None)]
    got = orphans(spark.createDataFrame(projects, P), spark.createDataFrame(solutions, S))
    rows = {tuple(r) for r in got.select("owner_kind", "owner_id", "ref_path", "state", "period").collect()}
    assert rows == {
        ("project", 1, "gone/G.csproj", "deleted", "2025-01"),
        ("project", 1, "late/L.csproj", "late", "2025-01"),
        ("project", 1, "nope/N.csproj", "missing", "2025-01"),
        ("project", 5, "x", "missing", None),
        ("solution", 1, "zzz", "missing", "2025-02"),
    }
    assert orphan_report(got).agg(F.sum("references")).first()[0] == 5


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"))
    filter_ = bloom_filter(keys, "k")
    asked = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("q"), "id")
    got = may_contain(asked, "q", filter_)
    assert got.where("id < 3000 and not maybe").count() == 0
    assert got.where("id >= 3000 and maybe").count() < 300


def test_empty(spark):
    assert orphans(spark.createDataFrame([], P), spark.createDataFrame([], S)).count() == 0

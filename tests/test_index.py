import pytest

from codeloom.functions import text as X
from codeloom.operators.index import Index, Unreadable
from codeloom.sources import workspace

FILES = "id long, path string, size long, hash long, lang string, line_count int, is_generated boolean"
SYMBOLS = "id long, file_id long, parent_id long, kind string, name string, ns string, container string, signature string, start_line int, end_line int"
PROJECTS = "id long, key string, dir string, name string, lang string"


def tables(spark, files, texts, symbols, projects=((1, "a/p.csproj", "a", "p", "cs"),)):
    f = spark.createDataFrame([(i, p, 1, h, "cs", 1, False) for i, p, h in files], FILES)
    c = spark.createDataFrame(texts, "file_id long, content string")
    s = spark.createDataFrame([(i, fid, None, "class", n, None, None, "", 1, 2) for i, fid, n in symbols], SYMBOLS)
    return f, c, s, spark.createDataFrame(list(projects), PROJECTS)


def test_refresh(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/i")
    index.build(*tables(spark, [(1, "a/x.cs", 1), (2, "a/y.cs", 1), (3, "b/z.cs", 1)], [(1, "one two"), (2, "two"), (2, "two"), (3, "three")], [(10, 1, "X"), (11, 2, "Y"), (12, 3, "Z")]), {"schema": "1", "k": "old"})
    now = tables(spark, [(1, "a/x.cs", 1), (2, "a/y.cs", 9), (4, "a/w.cs", 1)], [(1, "one two"), (2, "twenty"), (4, "four four")], [(10, 1, "X"), (21, 2, "Y2"), (14, 4, "W")])
    before = index.read_part("files")
    acts = {r["path"]: r["action"] for r in index.refresh(*now, {"k": "new"}).collect()}
    assert acts == {"a/x.cs": "skip", "a/y.cs": "replace", "a/w.cs": "insert", "b/z.cs": "delete"}
    assert {r["id"] for r in before.collect()} == {1, 2, 3}
    assert {(r["token"], r["file_id"], r["tf"]) for r in index.read_part("postings").collect()} == {("one", 1, 1), ("two", 1, 1), ("twenty", 2, 1), ("four", 4, 2)}
    assert {r["name"] for r in index.read_part("symbols").collect()} == {"X", "Y2", "W"}
    assert {(r["file_id"], r["project_id"]) for r in index.read_part("owners").collect()} == {(1, 1), (2, 1), (4, 1)}
    assert {tuple(r) for r in index.read_part("meta").collect()} == {("schema", "1"), ("k", "new")}
    # nothing new: no version
    v = index.version()
    assert {r["action"] for r in index.refresh(*now).collect()} == {"skip"} and index.version() == v
    # a changed file that cannot be read stops all of it
    f, c, s, p = tables(spark, [(1, "a/x.cs", 2), (4, "a/w.cs", 5)], [(4, "new")], [])
    with pytest.raises(Unreadable):
        index.refresh(f, c, s, p)
    assert index.version() == v
    # new projects move owners of files that did not change
    f, c, s, _ = now
    index.refresh(f, c, s, spark.createDataFrame([(7, "q.csproj", "", "q", "cs")], PROJECTS))
    assert {(r["file_id"], r["project_id"]) for r in index.read_part("owners").collect()} == {(1, 7), (2, 7), (4, 7)}
    other = index.copy_to(f"file://{tmp_path}/copy")
    assert other.version() == 1 and other.read_part("contents").count() == 3


def test_utf8_prefix(spark):
    words = ["", "abc", "aé漢😀b", "漢" * 9, "😀" * 5, None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for n in (0, 1, 2, 3, 4, 5, 7, 8, 12):
        for r in df.select("w", X.utf8_prefix(df["w"], n).alias("p")).collect():
            want = None if r["w"] is None else r["w"].encode()[:n].decode("utf-8", "ignore")
            assert r["p"] == want, (r["w"], n)


def test_lists():
    assert X.parse_list(None) == X.parse_list(" ") == [] and X.parse_list("a, b,,a") == ["a", "b"] and X.parse_list('["x y", "z", ""]') == ["x y", "z"]
    for bad in ("[1]", "[", "x" * 70_000, ",".join(map(str, range(300)))):
        with pytest.raises(ValueError):
            X.parse_list(bad)


def test_glob_columns(spark):
    import re

    from pyspark.sql import functions as F

    globs = ["a/**/*.cs", "a/*.cs", "**/x?.cs", "src/**", "a.b/c+d/*.cs"]
    for r in spark.createDataFrame([(g,) for g in globs], "g string").select("g", X.glob_column_regex(F.col("g")).alias("r")).collect():
        for p in ("a/b/c.cs", "a/c.cs", "x1.cs", "q/x1.cs", "src/a/b", "a.b/c+d/e.cs", "aXb/c+d/e.cs"):
            assert bool(re.match(r["r"], p)) == bool(re.match(X.build_glob_regex(r["g"]), p)), (r["g"], p)


def test_projects_and_solutions(spark):
    xml = '<Project Sdk="S"><PropertyGroup><TargetFrameworks>net8.0;net9.0</TargetFrameworks></PropertyGroup><ItemGroup><Compile Remove="old/**" /><Compile Include="..\\\\s\\\\*.cs" Link="x" /><PackageReference Version="1" Include="xunit" /><Reference Include="A, Version=1" /><InternalsVisibleTo Include="T" /></ItemGroup></Project>'
    p = workspace.projects(spark.createDataFrame([("p", "csproj", xml)], "path string, lang string, text string")).first()
    assert (p["frameworks"], p["removes"], p["packages"], p["assembly_refs"], p["visible_to"], p["is_test"], p["load_status"]) == ("net8.0;net9.0", ["old/**"], ["xunit"], ["A, Version=1"], ["T"], True, "parsed")
    rows = [("1", "a.sln", 'Project("{x}") = "A", "s\\A.csproj", "{y}"\nProject("{x}") = "folder", "docs", "{z}"'), ("2", "b.slnx", '<Solution><Project Path="s/B.fsproj" /></Solution>'), ("3", "c.slnf", '{"solution": {"path": "x.sln", "projects": ["s\\\\C.csproj"]}}'), ("4", "d.slnf", "{")]
    got = {(r["path"], r["member"]) for r in workspace.solution_projects(spark.createDataFrame(rows, "path string, name string, text string")).collect()}
    assert got == {("1", "s/A.csproj"), ("2", "s/B.fsproj"), ("3", "s/C.csproj")}

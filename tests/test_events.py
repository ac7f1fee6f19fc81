import datetime as dt
import json

from codeloom.operators import events as E
from codeloom.sources import workspace
from codeloom.sources.tables import Scratch
from codeloom.sources.versions import VersionedTable
from codeloom.streaming import telemetry

LINES = [
    {"e": "semanticOp", "ts": "2025-01-01T00:00:10Z", "corr": "c1", "tool": "references", "result": "partial", "clusterLoadMs": 1000, "queryMs": 500},
    {"e": "semanticOp", "ts": "2025-01-01T00:00:20Z", "corr": "c1", "tool": "references", "result": "exact"},
    {"e": "telemetry_dropped", "count": 3},
    {"e": "buildProgress", "ts": "2025-01-01T00:00:30Z", "buildId": "b", "state": "running"},
]


def write_log(folder):
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join([*map(json.dumps, LINES), "not json", "[1]"]) + "\n")


def test_normalise_and_tail(spark, tmp_path):
    write_log(tmp_path / "log")
    rows = E.normalise(spark.read.text(str(tmp_path / "log"))).collect()
    kinds = sorted(r["kind"] for r in rows)
    assert kinds == ["buildProgress", "invalid", "invalid", "semanticOp", "semanticOp", "telemetry_dropped"]
    part = next(r for r in rows if r["partial"])
    assert (part["outcome"], part["confidence"], part["duration_ms"]) == ("success", "partial", 1500.0)
    assert part["emitted_at"] - part["started_at"] == dt.timedelta(milliseconds=1500)
    assert next(r for r in rows if r["kind"] == "telemetry_dropped")["dropped"] == 3
    got = telemetry.drain(telemetry.tail(spark, str(tmp_path / "log")), Scratch(spark, "t"), "append")
    assert sorted(r["kind"] for r in got.collect()) == kinds


def test_keep_latest_repeats_nothing(spark, tmp_path):
    write_log(tmp_path / "log")
    state = VersionedTable(spark, f"file://{tmp_path}/state", "correlation_id string, emitted_at timestamp, outcome string, confidence string")
    for _ in range(2):
        stream = telemetry.tail(spark, str(tmp_path / "log")).where("correlation_id is not null")
        telemetry.keep_latest(stream, state, "correlation_id", ["emitted_at"], f"file://{tmp_path}/cp").awaitTermination()
    assert [(r["correlation_id"], r["confidence"]) for r in state.read().collect()] == [("c1", "exact")]
    assert state.version() == 1  # the second run found nothing new


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", "k long, v string")
    df = lambda *rows: spark.createDataFrame(rows, "k long, v string")
    t.publish(t.stage(df((1, "a"), (2, "b"))))
    before = t.read()
    t.replace(df((2, "c"), (3, "d")), "k")
    assert {tuple(r) for r in before.collect()} == {(1, "a"), (2, "b")}
    assert {tuple(r) for r in t.read().collect()} == {(1, "a"), (2, "c"), (3, "d")}
    t.remove(df((1, "")), "k")
    assert {r["k"] for r in t.read().collect()} == {2, 3}


def test_workspace(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "obj").mkdir()
    (tmp_path / "src" / "A.cs").write_text("class A { }\n")
    (tmp_path / "src" / "x.bin").write_text("?")
    (tmp_path / "obj" / "B.cs").write_text("class B { }")
    (tmp_path / "src" / "A.csproj").write_text('<Project Sdk="S"><PropertyGroup><TargetFramework>net8.0</TargetFramework></PropertyGroup><ItemGroup><ProjectReference Include="..\\B.csproj" /><PackageReference Include="p" Version="1" /></ItemGroup></Project>')
    (tmp_path / "src" / "bad.csproj").write_text("<Project>")
    (tmp_path / "S.sln").write_text('Project("{1}") = "A", "src/A.csproj"\n')
    files = workspace.scan(spark, str(tmp_path)).cache()
    assert {(r["path"], r["lang"], r["line_count"]) for r in files.collect()} == {("src/A.cs", "cs", 2), ("src/A.csproj", "csproj", 1), ("src/bad.csproj", "csproj", 1), ("S.sln", "sln", 2)}
    p = {r["path"]: r for r in workspace.projects(files).collect()}
    assert p["src/A.csproj"]["project_refs"] == ["..\\B.csproj"] and p["src/A.csproj"]["packages"] == ["p"] and p["src/A.csproj"]["frameworks"] == "net8.0"
    assert p["src/bad.csproj"]["load_status"] == "failed:xml"
    assert [tuple(r) for r in workspace.solutions(files).collect()] == [("S.sln", "A", "src/A.csproj")]

from pathlib import Path

import pytest

from codeloom.operators import extract as X

CS = """using System;

namespace A.B;

[Obsolete]
public class Outer<T> : IBase
{
    string s = "class No { void M() { } }"; // class No2 {
    public int P { get; set; } = F(1);

    public Outer(int x) : base(x)
    {
        if (x > 1) { Call(); }
    }

#if X
    void M(Func<int> f) {
#else
    void M() {
#endif
        var q = new Thing(1) { A = 2 };
    }

    int Short(int a) => a + 1;

    enum E { One, Two }
}
interface I
{
    void Run(string a);
}
"""

FS = """module Top.Name

open System

type Row =
    { Id: int }

type U =
    | A
    | B

module Ops =
    let f (x: int) =
        let inner y = y
        inner x

let value = 3
let g a b =
    a + b
"""


def test_csharp():
    got = {(k, n, c, a, b) for k, n, c, a, b in X.csharp(CS)}
    assert got == {
        ("class", "Outer", None, 5, 27), ("constructor", "Outer", "Outer", 11, 14), ("method", "M", "Outer", 16, 22), ("method", "Short", "Outer", 24, 24),
        ("enum", "E", "Outer", 26, 26), ("interface", "I", None, 28, 31), ("method", "Run", "I", 30, 30),
    }


def test_fsharp():
    assert set(X.fsharp(FS)) == {("module", "Name", None, 1, 19), ("record", "Row", None, 5, 6), ("union", "U", None, 8, 10), ("module", "Ops", None, 12, 15), ("function", "f", "Ops", 13, 15), ("function", "g", None, 18, 19)}


def test_dirt(spark):
    assert X.csharp("") == [] and X.fsharp("") == []
    assert X.csharp("class A { void M() {") == [("class", "A", None, 1, 1), ("method", "M", "A", 1, 1)]
    rows = [(1, CS), (1, CS), (2, FS), (3, None), (4, ""), (None, FS)]
    got = X.declarations(spark.createDataFrame([(*r, "x") for r in rows], "file_id long, content string, name string"))
    assert {r["file_id"]: r["count"] for r in got.groupBy("file_id").count().collect()} == {1: 7, 2: 6, None: 6}
    assert X.declarations(spark.createDataFrame([], "file_id long, content string")).count() == 0


def test_agrees_with_the_stored_symbols(spark):
    d = Path("/root/testdata/sf0.001")
    if not d.exists():
        pytest.skip("no test data")
    from codeloom.operators.store import Store

    s = Store(spark, str(d))
    got = {(r["file_id"], r["name"], r["start_line"]) for r in X.declarations(s.contents).collect()}
    kinds = "kind in ('class','interface','struct','record','enum','method','constructor','function')"
    want = {(r["file_id"], r["name"], r["start_line"]) for r in s.symbols.where(kinds).join(s.contents.select("file_id"), "file_id", "left_semi").collect()}
    assert len(got & want) > 0.97 * len(want)


FULL = """using System;
namespace A.B;
[Obsolete("x")]
public sealed class C<T> : D where T : class
{
    private readonly int _x = 1, _y;
    public const string K = "a{b";
    public event Action? E;
    [HttpGet] public Guid Folder { get; private set; }
    public int N => 3;
    public int this[int i] { get { return i; } }
    public C(int a) { _x = a; if (a > 1) { } }
    public async Task<int> M<U>(U u, int b) { var q = 1; return 2; }
    public string Q { get; init; } = "z";
    void F();
    public delegate void H(int a);
}
enum G : byte { One = 1, [X] Two,
   Three }
"""


def test_full_declarations(spark):
    got = {(r["kind"], r["name"]): r for r in X.full_declarations(spark.createDataFrame([(1, FULL), (2, None), (3, ""), (4, "\ufeffmodule A.B\n\nlet private f (x: int) = x\n")], "file_id long, content string")).collect()}
    assert set(got) == {("class", "C"), ("field", "_x"), ("field", "K"), ("event", "E"), ("property", "Folder"), ("property", "N"), ("indexer", "this"), ("constructor", "C"), ("method", "M"), ("property", "Q"), ("method", "F"), ("delegate", "H"), ("enum", "G"), ("enum_member", "One"), ("enum_member", "Two"), ("enum_member", "Three"), ("module", "B"), ("function", "f")}
    c, p, m, e = got["class", "C"], got["property", "Folder"], got["method", "M"], got["enum_member", "Three"]
    assert (c["signature"], c["accessibility"], c["modifiers"], c["arity"], c["attr_markers"], c["ns"]) == ("public sealed class C<T> : D where T : class", "public", "sealed", 1, "Obsolete", "A.B")
    assert (p["signature"], p["accessors"], p["attr_markers"], p["container"]) == ("public Guid Folder { get; private set; }", "get=public;set=private", "HttpGet", "C")
    assert (m["signature"], m["modifiers"], m["arity"], m["declaration_key"]) == ("public async Task<int> M<U>(U u, int b)", "async", 1, "method|C.M|" + "public async Task<int> M<U>(U u, int b)"[-40:])
    assert (e["container"], e["start_line"], got["function", "f"]["accessibility"], got["function", "f"]["ns"]) == ("G", 19, "private", "A.B")

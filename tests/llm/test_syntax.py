import random

import pytest

from codeloom.llm import grammar_cs, grammar_other as G, syntax

CS_GOOD = [
    "", "// only a comment\n/* { */", "﻿using System;\nnamespace A;\npublic class B { }",
    "class A<T> : B<T>, IC where T : class, new() { int x = 1, y; public int P { get; private set; } = 3; int this[int i] => x; ~A() { } event E e; static A operator +(A a, A b) => a; }",
    "record P(int X, int Y); record struct Q { } enum E : byte { A = 1, [X] B, } delegate void D<T>(T t); interface I { void M(); int N { get; } }",
    "class A { void M() { for (int i = 0, j = 1; i < 3; i++, j--) { if (i > 1) continue; else { break; } } foreach (var (a, b) in xs) M(); while (true) ; do { x++; } while (x < 3); switch (x) { case 1: case 2 when y: return; case string s: break; default: goto case 1; } try { } catch (E e) when (e.X) { throw; } finally { } lock (x) { } using (var r = F()) { } using var q = G(); } }",
    'class A { string s = @"a ""q"" { "; string t = $"x {y:0.0} {{ {f("}")} "; char c = \'"\', d = \'\\u0041\'; string r = """raw " { """; }',
    "class A { int F() => x switch { 1 => 2, > 3 and < 5 => 4, { P: 1 } => 5, null => 6, _ => 7 }; void G() { var a = new[] { 1, 2 }; var b = new B { X = 1, Y = { 2 }, [3] = 4 }; var c = xs.Where(x => x.A == 1 && !x.B).Select(x => { return x; }).ToList(); int[] d = { 1, 2 }; F(ref x, out var y, name: z); Func<int, int> f = delegate(int q) { return q; }; var t = (1, 2); (int p, var w) = t; a ??= b?.C?[1]; var e = x is B { Y: 2 } k ? 1 : 2; var g = (int)x + (A)(y); d = [1, .. e]; } }",
    "class A {\n#if X\n void M() {\n#else\n void N() {\n#endif\n }\n}", "[assembly: X(\"y\")]", "var x = 1;\nConsole.WriteLine(x);", "class A { async Task M() { await foreach (var x in y) { } await using (z) { } int L(int q) { return q; } static int K() => 1; } }",
]
CS_BAD = [
    "class A {", "class A { } }", 'class A { string s = "x; }', "class A { /* open }", "class A { void M( { } }", "class A { void M() { x = ; } }", "class A { void M() { if (x { } } }", "class A { void M() { foo(1,); } }", "class A {\n<<<<<<< HEAD\n int x;\n=======\n int y;\n>>>>>>> b\n}",
    "# Title\n\nSome words.", "<html></html>", "module A\n\nlet x = 1", "class A {\n#if X\n}", "blob-pointer v1\noid x:12\nsize 3", "\x00\x00", "class A { void M() { else { } } }", "class A { void M() { try { } x(); } }", "class A { int x }", "public class { }", "SELECT * FROM t",
]
FS_GOOD = [
    "", "// c", "module A.B\n\nopen System\n\n[<Literal>]\nlet x = 1\n\nlet inline f (a: int) (b: string) : int =\n    let c = a + b.Length\n    if c > 1 then \"{\" + b else sprintf \"%d\" c\n",
    "namespace A\n\ntype R =\n    { Id: int; Name: string }\n\ntype U =\n    | A of int\n    | B\n\nmodule M =\n    let f x =\n        match x with\n        | 0 -> None\n        | n when n > 1 -> Some n\n        | _ -> Some (x * 3)\n",
    "let xs = [ 1 .. 9 ] |> List.filter (fun x -> x % 7 = 0) |> List.sum\nlet rows = [|\n    (1, 2.5, \"a\")\n    (2, 3.5, \"b\")\n  |]\nlet t = [|(fun a b->a*39+b-34);(fun a b->a)|]\n(* note (* nested *) *)\nlet y = xs.[0]\nlet z = function | 1 -> 'a' | _ -> 'b'\n",
    "module A\nlet f () =\n    for i in 1 .. 3 do\n        printfn \"%d\" i\n    while true do\n        ()\n    try\n        g ()\n    with\n    | e -> raise e\n",
]
FS_BAD = ["module A\nlet = 3", "module A\nlet total =", 'module A\nlet t = "unfinished', "module A\n(* open", "module A\nlet r = [ 1; 2", "module A\nlet f x =\n    match x with", "module A\nlet f x =\n    if x then", "module A\nlet f x =\n    x |> List.map (fun y ->", "using System;\n\npublic class A { }", "# T\n\nwords here.", "<a></a>", "\x00", "module A\n<<<<<<< HEAD\nlet x = 1\n=======\nlet x = 2\n>>>>>>> b\n"]
SQL_GOOD = [
    "", "-- c\nCREATE TABLE dbo.A (Id INT NOT NULL, N NVARCHAR(80) NULL, D DATETIME2 DEFAULT GETDATE(), CONSTRAINT PK PRIMARY KEY (Id));\nINSERT INTO dbo.A VALUES (1, 'open (', N'It''s');",
    "INSERT INTO t (a, b) VALUES\n(1, 'x'),\n(2, 'y');\nUPDATE t SET a = 1, b = 'q' WHERE c = 'd' AND (e IN (1, 2) OR f LIKE '%x');\nDELETE FROM t WHERE a BETWEEN 1 AND 2;", "CREATE LOGIN s WITH PASSWORD = '$(P)'; ALTER TABLE dbo.L ADD H VARBINARY(64) NULL;",
    "SELECT TOP 3 a.x AS y, COUNT(*) n, CASE WHEN a.z > 1 THEN 'p' ELSE 'q' END FROM dbo.a AS a LEFT JOIN [b c] b ON a.i = b.i WHERE EXISTS (SELECT 1 FROM q) GROUP BY a.x HAVING COUNT(*) > 2 ORDER BY a.x DESC", "create table t0(a int not null,b int,c nvarchar(32));create index i0 on t0(a,b);",
    "CREATE PROCEDURE p @a INT AS\nBEGIN\n  SET @a = 1;\n  IF @a > 1 SELECT 1 ELSE SELECT 2;\n  EXEC q @a;\nEND\nGO\nWITH c AS (SELECT 1 AS x) SELECT x FROM c;",
]
SQL_BAD = ["SELEC * FRM dbo.T WHERE;", "CREATE TABLE dbo.T (Id INT NOT NULL,", "INSERT INTO t VALUES (1, 'open;", "/* open note", "CREATE TABLE t (a INT NOT NULL b INT)", "UPDATE t SET WHERE a = 1", "SELECT * FROM t WHERE", "diff --git a/x b/x", "CREATE TABLE t (\n    a INT,\n=======\n    b INT\n);", "class A { }", "SELECT a FROM t WHERE b = 1 AND"]


@pytest.mark.parametrize("s", CS_GOOD)
def test_cs_good(s):
    assert grammar_cs.parses(s)


@pytest.mark.parametrize("s", CS_BAD)
def test_cs_bad(s):
    assert not grammar_cs.parses(s)


@pytest.mark.parametrize("s", FS_GOOD)
def test_fs_good(s):
    assert G.fs_parses(s) and G.fs_parses("﻿" + s.replace("\n", "\r\n"))


@pytest.mark.parametrize("s", FS_BAD)
def test_fs_bad(s):
    assert not G.fs_parses(s)


@pytest.mark.parametrize("s", SQL_GOOD)
def test_sql_good(s):
    assert G.sql_parses(s)


@pytest.mark.parametrize("s", SQL_BAD)
def test_sql_bad(s):
    assert not G.sql_parses(s)


def test_xml_and_json():
    assert G.xml_parses('﻿<?xml version="1.0" encoding="utf-16"?><a b="1"/>') and G.xml_parses("<a><!-- < --></a>")
    assert not any(map(G.xml_parses, ["", "<a>", "<a></a><b/>", "<a></a>text", "{}", "<a b=1/>", "\x00"]))
    assert G.json_parses('﻿{"a": [1, 2.5e3, null, true, "\\u0041"]}') and not any(map(G.json_parses, ["", "{", '{"a": 1,}', '{"a": 1} x', "{'a': 1}", "[NaN]", "// c\n{}"]))


def test_truncated_code_never_parses():
    r = random.Random(0)
    for s in CS_GOOD[4:9]:
        for _ in range(30):
            cut = s[: r.randrange(len(s) // 3, len(s) - 2)]
            depth = grammar_cs.mask(cut)
            if depth is None or depth.count("{") != depth.count("}"):
                assert not grammar_cs.parses(cut)


def test_table(spark):
    files = [(1, "r/a.cs", "cs"), (2, "r/b.cs", "cs"), (3, "r/c.fs", "fs"), (4, "r/d.json", "config"), (5, "q/e.config", "config"), (6, "q/f.md", "md"), (7, "q/g.sql", "sql"), (8, None, "cs"), (9, "q/h.cs", None), (10, "q/i.cs", "cs"), (11, "q/j.fs", "fs"), (12, "q/k.csproj", "csproj"), (13, "q/l.cs", "cs"), (14, "q/m.fs", "fs")]
    texts = [(1, "class A { }"), (1, "class A { }"), (2, "class A {"), (3, "using System;\nclass A { public void M(); }"), (4, '{"a": 1}'), (5, '{"a": 1}'), (6, "{{{"), (7, "SELECT 1;"), (8, "class"), (9, "x"), (10, None), (11, ""), (12, ""), (13, "// c"), (14, "// c"), (None, "class A { }")]
    f = spark.createDataFrame([(*x, 1, True) for x in files], "id long, path string, lang string, file_id long, ok boolean")
    c = spark.createDataFrame([(*x, 9, 8) for x in texts], "file_id long, content string, id long, good int")
    got = {r["file_id"]: r["verdict"] for r in syntax.verdicts(f, c).collect()}
    assert got == {1: "ok", 2: "corrupt", 3: "wrong extension", 4: "ok", 5: "wrong extension", 7: "ok", 8: "corrupt", 11: "ok", 12: "wrong extension", 13: "ok", 14: "ok"}
    rate = {(r["repo"], r["lang"]): (r["files"], r["failed"]) for r in syntax.rates(syntax.verdicts(f, c)).collect()}
    assert rate[("r", "cs")] == (2, 1)
    assert syntax.verdicts(f.limit(0), c.limit(0)).count() == 0
    assert syntax.verdicts(f, c.limit(0)).count() == 0


FS_TYPES = """module A.B

type R =
    { Id: int
      mutable Name: string -> int
      [<X>]
      P: Map<string, int> }
    member x.Total = x.Id + 1
    static member Create(a: int, ?b: string) : R =
        let c = defaultArg b ""
        { Id = a; Name = c }

type U =
    | A of x: int * y: string
    | B
    override this.ToString() =
        match this with
        | A (x, _) -> string x
        | B -> "b"

and E =
    | X = 1
    | Y = 2

type C(a: int, b: string) as this =
    inherit Base(a)
    let mutable n = a
    static let rec f x = if x > 1 then g x else 2
    and g x = f (x - 1)
    do
        printfn "%d" n
        this.Run()
    new() = C(1, "x")
    [<DefaultValue>]
    val mutable private v: int
    abstract Go: int -> string
    abstract member P: int with get, set
    default x.Go y = sprintf "%d" y
    member val Q = 3 with get, set
    member private _.N
        with get () = n
        and set (w: int) = n <- w
    member inline x.Item with get (i: int) = i + n
    static member (+) (p: C, q: C) = p
    interface IDisposable with
        member x.Dispose() =
            n <- 0
            ()

type I =
    abstract M: unit -> int

type K =
    class
    end

type D = delegate of int -> int
type Z = int -> string
type W = V of int
type C with
    member x.More = 1

exception Oops of string * int

type L
    (
        a: int,
        b: string
    ) =
    inherit IB<int>(a)
    static extern int foo()
    new () = { inherit IB<int>(1) }

type S = S of string with
    member x.V = 1

type N = {| X: int |}

let d = { new IDisposable with member _.Dispose() = () }
let e = { new IC<int> with member _.F(a) = a }
"""


def test_fs_type_bodies():
    assert G.fs_parses(FS_TYPES)


@pytest.mark.parametrize(
    "old, new",
    [("x.Id + 1", ""), ("x.Id + 1", "x.Id +"), ("| B\n    over", "| B of\n    over"), ("let mutable n = a", "let mutable = a"), ("int -> string\n    abstract m", "int ->\n    abstract m"), ("n <- 0", "n <-"), ("member x.More = 1", "member x.More 1"), ("member x.More = 1", ""), ("string * int", "string *"), ("| Y = 2", "| 2"), ("new() =", "new() "), ("inherit Base(a)", "inherit"), ("n <- w", "n <- )w("), ("printfn \"%d\" n", "if n then"), ("Dispose() = ()", "Dispose() =")],
)
def test_fs_broken_type_bodies(old, new):
    assert old in FS_TYPES and not G.fs_parses(FS_TYPES.replace(old, new, 1))


# constructs of the languages that are used less often, and texts that only look like them
CS_MORE = [
    'class A<T> where T : class?, new() { }',
    'class A { void M() { var a = stackalloc int[] {1,2}; } }',
    'class A { void M() { switch (x) { case { A: > 3, B.C: null }: break; } } }',
    'class A { void M() { var z = x switch { var q when q.A => 6, _ => 1 }; } }',
    'class A { void M() { var z = x is [var y, .. var z2]; } }',
    'class A { void M() { var z = x switch { [var y, .. var w] => 1, [] => 2, [1, .., 3] => 4 }; } }',
    'unsafe class A { delegate* unmanaged[Cdecl]<int, void> f; delegate*<int, int> g; }',
    'class A<T> where T : allows ref struct { }',
    'class A { void M<T>() where T : IDisposable, allows ref struct { } }',
    'class A { void M() { int[] a = [1, .. b, 2]; } }',
    'class A { void M() { foreach (var (a, b) in c) { } } }',
    'class A { void M() { var (a, b) = (1, 2); } }',
    'file class A { required public int X { get; init; } }',
    'class A { void M() { var s = $"""x {y} z"""; } }',
    'class A { void M() { if (x is not null and { Length: > 3 }) return; } }',
    'class A { void M() { await foreach (var x in y) { } } }',
    'class A { void M() { using var a = b; } }',
    'record A(int X) : B(X);',
    'public readonly record struct P(int X, int Y);',
    'class A { void M() { var f = static (int x) => x; } }',
    'class A { void M() { x ??= new(); } }',
    'class A { void M() { y = x with { A = 1 }; } }',
    'class A { void M() { goto case 1; } }',
    'class A { void M() { Span<int> s = stackalloc int[3]; } }',
    'class A { void M() { ref readonly var q = ref x; } }',
    'class A(int x) { int Y => x; }',
    'class A { void M() { var t = (a: 1, b: 2); } }',
    'namespace A; class B { }',
    'class A { public static A operator +(A a, A b) => a; public static explicit operator checked int(A a) => 1; }',
    'class A { event Action E { add { } remove { } } int this[int i] => i; ~A() { } }',
    'extern alias X; using static System.Math; class A { }',
    'class A { void M() { lock (x) { } checked { } unsafe { fixed (int* p = a) { } } } }',
    'class A { void M() { var x = from a in b where a > 1 orderby a descending group a by a.X into g select g; } }',
    'interface I { static abstract int M(); }',
    'class A { void M() { using (var x = y) { } } }',
    '[assembly: A(1)]\nclass B { }',
    'partial class A { partial int X { get; } }',
]
FS_MORE = [
    'let rec f x = g x\nand g x = f x\n',
    'let a = struct (1, 2)\n',
    'let q = <@ 1 + 2 @>\n',
    'let q = <@@ 1 @@>\n',
    'let d = 3.0<m>\n',
    'let d = 3<kg/m^2>\n',
    '[<Measure>] type m\n',
    'let rec f x =\n    g x\nand g x =\n    f x\n',
    'let f (struct (a, b)) = a\n',
    'let x = if a then b else c\n',
    'let f = function\n    | 1 -> 2\n    | _ -> 3\n',
    'let s = seq { for x in 1 .. 3 do yield x }\n',
    'let a = async {\n    let! x = y\n    return x\n}\n',
    'let (|A|B|) x = if x then A else B\n',
    'type A =\n    | B of int\n    | C\n    with member x.Y = 1\n',
    'let inline f< ^T when ^T : (static member M : int)> x = x\n',
    'let x = { a with B = 1 }\n',
    'let o = { new IDisposable with member _.Dispose() = () }\n',
    'let x = query { for a in b do where (a > 1) select a }\n',
    'let f x = x |> List.map (fun y -> y + 1)\n',
    'let x = a.[1]\nlet y = a[1]\nlet z = a.[1..2]\n',
    'let mutable x = 1\nx <- 2\n',
    'let x = $"a {b} c"\n',
    'module A =\n    let x = 1\n',
    'let f (x: int, ?y: string) = x\n',
    'let f x = try g x with | :? E as e -> 1 | _ -> 2\n',
    'let a = typeof<int>\n',
    'let a = &&x\n',
    'type R = struct\n    val X: int\nend\n',
    'let a, b = 1, 2\n',
    'let x = lazy (1)\n',
    'let f = (+) 1\n',
    'let x = 1 :> obj\n',
    'let f x : int = x\n',
    'type A() =\n    let x = 1\n    do printfn ""\n    member val P = 1 with get, set\n    static member M(x) = x\n    abstract Q : int -> int\n    default _.Q x = x\n    interface I with\n        member _.Z = 1\n',
    'exception E of string\n',
]
SQL_MORE = [
    "SELECT a FROM t FOR XML PATH('');",
    'SELECT * FROM t PIVOT (SUM(x) FOR y IN ([a], [b])) AS p;',
    'SELECT * FROM t UNPIVOT (v FOR c IN (a, b)) u;',
    "SELECT * FROM OPENJSON(@j) WITH (a int '$.a', b nvarchar(max) AS JSON) x;",
    'UPDATE t SET a = 1 OUTPUT inserted.a INTO @x FROM t JOIN u ON t.i = u.i WHERE b = 2;',
    'DELETE TOP (10) FROM t WHERE a = 1;',
    'SELECT a, SUM(b) FROM t GROUP BY GROUPING SETS ((a), ());',
    'SELECT a, SUM(b) FROM t GROUP BY a WITH ROLLUP;',
    'SELECT TOP 10 PERCENT WITH TIES a FROM t ORDER BY a;',
    "SELECT STRING_AGG(a, ',') WITHIN GROUP (ORDER BY a) FROM t;",
    "SELECT a AT TIME ZONE 'UTC' FROM t;",
    'DECLARE c CURSOR FAST_FORWARD FOR SELECT a FROM t; OPEN c; FETCH NEXT FROM c INTO @a; CLOSE c; DEALLOCATE c;',
    'MERGE t AS x USING (SELECT 1 AS a) AS s ON x.a = s.a WHEN MATCHED AND x.b > 1 THEN UPDATE SET b = 2 WHEN NOT MATCHED BY TARGET THEN INSERT (a) VALUES (s.a) WHEN NOT MATCHED BY SOURCE THEN DELETE OUTPUT $action, inserted.a;',
    "BACKUP DATABASE d TO DISK = 'x' WITH INIT, COMPRESSION;",
    'KILL 53;',
    'GRANT SELECT, INSERT ON dbo.t TO u WITH GRANT OPTION;',
    "WAITFOR DELAY '00:00:05';",
    "DBCC CHECKDB ('x') WITH NO_INFOMSGS;",
    "RESTORE DATABASE d FROM DISK = 'x' WITH REPLACE;",
    "BULK INSERT t FROM 'f' WITH (FIELDTERMINATOR = ',');",
    'GOTO done;',
    'REVOKE EXECUTE ON dbo.p FROM u;',
    'SELECT SUM(a) OVER (PARTITION BY b ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) FROM t;',
    'INSERT INTO t (a) OUTPUT inserted.a VALUES (1);',
    'DELETE t OUTPUT deleted.a FROM t INNER JOIN u ON t.i=u.i;',
    "SELECT IIF(a>1, 'x', 'y'), TRY_CAST(a AS int) FROM t WITH (NOLOCK);",
    'ALTER INDEX i ON t REBUILD;',
    'CREATE TABLE t (a int NOT NULL PRIMARY KEY, b AS (a*2) PERSISTED, INDEX ix (a)) WITH (DATA_COMPRESSION = PAGE);',
    'SELECT a FROM t ORDER BY a OFFSET 10 ROWS FETCH NEXT 5 ROWS ONLY OPTION (RECOMPILE);',
    'TRUNCATE TABLE t;',
    'SELECT * FROM t CROSS APPLY (SELECT TOP 1 * FROM u WHERE u.i = t.i) x;',
    'DECLARE @t TABLE (a int); SET NOCOUNT ON; EXEC sp_x @a = 1, @b OUTPUT;',
    'SELECT a FROM t GROUP BY CUBE (a, b) HAVING COUNT(*) > 1;',
    'SELECT NEXT VALUE FOR s;',
    "IF EXISTS (SELECT 1 FROM t) BEGIN PRINT 'x'; END ELSE PRINT 'y';",
    'UPDATE TOP (5) x SET a = 1 FROM t AS x;',
    'CREATE OR ALTER PROCEDURE p @a int = 1 AS BEGIN SET NOCOUNT ON; SELECT @a; END',
    'CREATE TRIGGER tr ON t AFTER INSERT AS SELECT 1;',
    'CREATE TYPE dbo.x AS TABLE (a int);',
    "SELECT a.value('(/x)[1]', 'int') FROM t;",
    'FETCH NEXT FROM c;',
    'SET TRANSACTION ISOLATION LEVEL READ COMMITTED;',
    'SET IDENTITY_INSERT t ON;',
]
BADSQL_MORE = [
    'MERGE t USING 1 2 3 potato WHEN;',
    'BACKUP zzz zzz 1 2 3',
    'KILL x y z',
    'GRANT 1 2 3;',
    'WAITFOR potato;',
    'MERGE t USING s ON a = b;',
    'RESTORE;',
    'FETCH 1 2 3 potato;',
    'DBCC;',
    'SELECT a FROM t FOR XML potato potato;',
    'DEALLOCATE 1 2;',
]
BADFS_MORE = [
    'let a = <@ 1 +\n',
    'let d = 3.0<\n',
    'let a = struct\n',
    'and g x = 1\n',
]
BADCS_MORE = [
    'class A<T> where T : { }',
    'class A { void M() { case { A: > }: break; } }',
    'class A { void M() { var a = stackalloc; } }',
    'class A { void M() { var z = x switch { var q when => 6 }; } }',
    'class A { void M() { x = [var y, ..; } }',
]


@pytest.mark.parametrize("parse,texts,valid", [(grammar_cs.parses, CS_MORE, True), (G.fs_parses, FS_MORE, True), (G.sql_parses, SQL_MORE, True), (grammar_cs.parses, BADCS_MORE, False), (G.fs_parses, BADFS_MORE, False), (G.sql_parses, BADSQL_MORE, False)])
def test_further_constructs(parse, texts, valid):
    assert [t for t in texts if parse(t) is not valid] == []


def test_every_grammar_is_tried():
    assert syntax.reads('{"a": 1}')[1] == "json" and syntax.reads("<a/>") == (syntax.BITS["xml"], "xml")
    good, best = syntax.reads("")
    assert good == syntax.BITS["cs"] | syntax.BITS["sql"] | syntax.BITS["fs"]
    assert syntax.reads("class A {") == (0, None)

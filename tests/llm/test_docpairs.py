import pytest

from codeloom.llm import docpairs as D

SYM = "id long, file_id long, parent_id long, kind string, name string, ns string, container string, signature string, start_line int"


@pytest.mark.parametrize("doc", ["<summary>Stops at the first sealed anchor.</summary>", "只返回尚未过期的记录", "<returns>Null when closed.</returns>", '<param name="x">Never null, see the notes on locks.</param>', "Renvoie les éléments changés", "<summary> Uses <see cref=\"Cache\"/> twice </summary>"])
def test_meaningful(doc):
    assert D.meaningful(doc, "DrainOutline")


@pytest.mark.parametrize("doc", ["", "<summary></summary>", "<summary>TODO</summary>", "TBD", "n/a", "-", "...", "<summary>Drains the outlines.</summary>", "Drain outline.", "<inheritdoc/>", '<param name="gauge">The gauge to use.</param><returns></returns>', "<summary>Summary</summary>", "todo: document", "<summary>Draining of an outline</summary>"])
def test_trivial(doc):
    assert not D.meaningful(doc, "DrainOutline")


def test_comments():
    s = "\n".join([
        "/// <summary>One.</summary>", "[Pure]", "#if X", "[A(", "  1)]", "#endif", "", "public void A() { }",  # 1-8
        "/// two", "// ordinary", "public void B() { }",  # 9-11
        "//// not a doc", "public void C() { }",  # 12-13
        "/** three", " * more", " */ public void D() { }",  # 14-16
        "(** four *)", "let e x = x",  # 17-18
        "/* plain */", "void F();", "/// five", "", "[B] void G();", "/// open end",  # 19-24
    ])
    got = [(a, b, t) for a, b, t in D.comments(s)]
    assert got == [(2, 8, "<summary>One.</summary>"), (16, 16, "three\nmore\n"), (18, 18, "four"), (22, 23, "five")]
    assert list(D.comments("")) == [] and list(D.comments('var x = @"\n/// no\n";\nvoid M();')) == []


def test_found_and_inherited(spark):
    one = "public interface IBase\n{\n    /// <summary>Explains the whole protocol.</summary>\n    void Run();\n    void Bare();\n}\n"
    two = "public class Mid : IBase\n{\n    /// <inheritdoc/>\n    public virtual void Run() { }\n    /// <inheritdoc/>\n    public void Bare() { }\n}\n"
    three = "public class Leaf : Mid, IOther<int>\n{\n    /// <inheritdoc cref=\"Mid.Run\"/>\n    public override void Run() { }\n    /// TODO\n    public void Stop() { }\n}\n"
    rows = [
        (1, 1, None, "interface", "IBase", "N", None, "interface IBase", 1), (2, 1, 1, "method", "Run", "N", "IBase", "void Run()", 4), (3, 1, 1, "method", "Bare", "N", "IBase", "void Bare()", 5),
        (4, 2, None, "class", "Mid", "N", None, "class Mid", 1), (5, 2, 4, "method", "Run", "N", "Mid", "void Run()", 4), (6, 2, 4, "method", "Bare", "N", "Mid", "void Bare()", 6),
        (7, 3, None, "class", "Leaf", "M", None, "class Leaf", 1), (8, 3, 7, "method", "Run", "M", "Leaf", "void Run()", 4), (9, 3, 7, "method", "Stop", "M", "Leaf", "void Stop()", 6),
        (10, 1, None, "property", "P", None, None, None, 4), (11, None, None, "method", "Q", None, None, None, 4), (12, 1, None, "method", None, None, None, None, 4), (13, 1, None, "method", "R", None, None, None, None), (2, 1, 1, "method", "Run", "N", "IBase", "void Run()", 4),
    ]
    sy = spark.createDataFrame([(*r, "x", 3) for r in rows], SYM + ", text string, line int")
    c = spark.createDataFrame([(1, one, "n"), (1, one, "n"), (2, two, "n"), (3, three, "n"), (4, None, "n"), (None, one, "n")], "file_id long, content string, name string")
    assert {r["symbol_id"] for r in D.found(sy, c).collect()} == {2}
    got = {r["symbol_id"]: (r["source_id"], r["documentation"]) for r in D.pairs(sy, c).collect()}
    assert got == {k: (2, "Explains the whole protocol.") for k in (2, 5, 8)}
    assert D.found(sy.limit(0), c.limit(0)).count() == 0 and D.pairs(sy, c.limit(0)).count() == 0


def test_hierarchies():
    cs = 'using N.Core;\nnamespace A.B;\n// class No : Way\n[X("class Fake : Base")]\npublic sealed class C<T>(int x, Func<int, string> f) : Base<T, List<int>>(x), global::N.IOne, ITwo<T> where T : IThree { }\nrecord struct R(int A);\ninterface I { }\nclass D\n  : C<int>\n{ string s = x is null ? "a : b" : "c"; }\n'
    got = list(D.hierarchy(cs))
    assert [(w, n) for w, n, _ in got] == [("space", "A.B"), ("import", "N.Core"), ("base", "C:Base"), ("base", "C:IOne"), ("base", "C:ITwo"), ("base", "D:C")]
    fs = "module A.B\nopen N.Core\n\ntype Leaf() =\n    inherit Mid(1)\n    interface IOne<int> with\n        member _.Run() = ()\n// inherit No\ntype Other = { X: int }\n"
    assert [(w, n) for w, n, _ in D.hierarchy(fs)] == [("space", "A.B"), ("import", "N.Core"), ("base", "Leaf:Mid"), ("base", "Leaf:IOne")]


def test_bases_are_looked_up_where_they_are_seen_and_at_any_depth(spark):
    """Types of one name in other namespaces are not mixed; chains and cycles both end."""
    rows, texts = [], []
    for k, (ns, doc) in enumerate([("N.One", "Explains the first protocol"), ("N.Two", "Explains the second protocol")]):
        texts.append((k, f"namespace {ns};\npublic class Base\n{{\n    /// {doc}\n    void Run();\n}}\n"))
        rows += [(100 + k, k, None, "class", "Base", ns, None, "", 2), (200 + k, k, 100 + k, "method", "Run", ns, "Base", "", 5)]
    texts.append((5, "using N.Two;\nnamespace Z;\nclass Leaf : Base\n{\n    /// <inheritdoc/>\n    void Run();\n}\n"))
    rows += [(300, 5, None, "class", "Leaf", "Z", None, "", 3), (301, 5, 300, "method", "Run", "Z", "Leaf", "", 6)]
    deep = 6
    for k in range(deep):
        texts.append((10 + k, f"namespace Q;\nclass T{k} : {'Base' if not k else f'T{k - 1}'}\n{{\n    /// <inheritdoc/>\n    void Run();\n}}\n" if k else "using N.One;\nnamespace Q;\nclass T0 : Base\n{\n    /// <inheritdoc/>\n    void Run();\n}\n"))
        rows += [(1000 + k, 10 + k, None, "class", f"T{k}", "Q", None, "", 2 if k else 3), (2000 + k, 10 + k, 1000 + k, "method", "Run", "Q", f"T{k}", "", 5 if k else 6)]
    texts.append((500, "namespace C;\nclass X : Y\n{\n    /// <inheritdoc/>\n    void Go();\n}\nclass Y : X\n{\n    /// <inheritdoc/>\n    void Go();\n}\n"))
    rows += [(9000, 500, None, "class", "X", "C", None, "", 2), (9001, 500, 9000, "method", "Go", "C", "X", "", 5), (9002, 500, None, "class", "Y", "C", None, "", 7), (9003, 500, 9002, "method", "Go", "C", "Y", "", 10)]
    sy = spark.createDataFrame(rows, SYM)
    c = spark.createDataFrame(texts, "file_id long, content string")
    got = {r["symbol_id"]: r["source_id"] for r in D.pairs(sy, c).collect()}
    assert got == {200: 200, 201: 201, 301: 201} | {2000 + k: 200 for k in range(deep)}


def test_bases_beyond_undocumented_types_parts_and_constructors(spark):
    """Documentation comes through types that say nothing, from the other part's bases, from base constructors, and from members of another name."""
    rows, texts = [], []

    def file(k, text, *declared):
        texts.append((k, text))
        rows.extend((i, k, None, kind, name, ns, container, signature, text.split("\n").index(line) + 1) for i, kind, name, ns, container, signature, line in declared)

    file(
        1, "namespace N;\nclass Root\n{\n/// Explains the protocol by number\nvoid Run(int n);\n/// Explains the protocol by word\nvoid Run(string s);\n/// Opens the archive lazily\nRoot(int n);\n/// Walks each branch twice\nvoid Walk();\n}",
        (1, "class", "Root", "N", None, "", "class Root"), (2, "method", "Run", "N", "Root", "void Run(int n)", "void Run(int n);"), (3, "method", "Run", "N", "Root", "void Run(string s)", "void Run(string s);"),
        (4, "constructor", "Root", "N", "Root", "Root(int n)", "Root(int n);"), (5, "method", "Walk", "N", "Root", "void Walk()", "void Walk();"),
    )
    file(10, "namespace N;\nclass Bare : Root\n{\nvoid Other();\n}", (10, "class", "Bare", "N", None, "", "class Bare : Root"))
    file(11, "namespace N;\nclass Mute : Bare\n{\n/// TODO\nvoid Run(string s);\n}", (11, "class", "Mute", "N", None, "", "class Mute : Bare"), (12, "method", "Run", "N", "Mute", "void Run(string s)", "void Run(string s);"))
    # the base list is in the one part, the comments are in the other
    file(20, "namespace N;\npartial class Leaf : Mute\n{\n}", (20, "class", "Leaf", "N", None, "", "partial class Leaf : Mute"))
    file(
        21, 'namespace N;\npartial class Leaf\n{\n/// <inheritdoc/>\nvoid Run(string s);\n/// <inheritdoc/>\nLeaf(int n);\n/// <inheritdoc cref="Root.Walk()"/>\nvoid Stroll();\n/// <inheritdoc/>\nvoid Nowhere();\n}',
        (21, "class", "Leaf", "N", None, "", "partial class Leaf"), (22, "method", "Run", "N", "Leaf", "void Run(string s)", "void Run(string s);"), (23, "constructor", "Leaf", "N", "Leaf", "Leaf(int n)", "Leaf(int n);"),
        (24, "method", "Stroll", "N", "Leaf", "void Stroll()", "void Stroll();"), (25, "method", "Nowhere", "N", "Leaf", "void Nowhere()", "void Nowhere();"),
    )
    sy, c = spark.createDataFrame(rows, SYM), spark.createDataFrame(texts, "file_id long, content string")
    got = {r["symbol_id"]: r["source_id"] for r in D.pairs(sy, c).collect()}
    assert got == {2: 2, 3: 3, 4: 4, 5: 5, 22: 3, 23: 4, 24: 5}
    assert {r["symbol_id"] for r in D.found(sy, c).collect()} == {2, 3, 4, 5}

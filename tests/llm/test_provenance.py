import math
import itertools

from codeloom.llm import provenance as P

OWN = "using System;\n\nnamespace Own.Core;\n\npublic class A\n{\n    public void M() { F(1); }\n}\n"
MIN = "namespace Own.Core{" + "".join(f"class a{i}{{int c;public int C(int a,int b){{if(a>b){{return a-c;}}for(int i=0;i<b;i++){{c+=i*2;}}return c;}}}}" for i in range(9)) + "}"
BLOB = "namespace Own.Core;\n\nstatic class B\n{\n    static readonly byte[] R = {\n" + "        0x23, 0x53, 0xe8, 0xcd, 0x5c, 0xa8,\n" * 20 + "    };\n}\n"


def test_features():
    assert P.features(OWN) == (0.0, 0.0, 0.0, 0.0, 0.0, "Own")
    assert P.features("// <auto-generated>\n" + OWN)[0] == 1.0
    assert P.features("// Licensed to us.\n// Code generated by Protomill 4.2. DO NOT EDIT.\n" + OWN)[0] == 1.0
    assert P.features(OWN.replace("public class", '[System.CodeDom.Compiler.GeneratedCode("T", "1.0")]\npublic class'))[0] == 1.0
    assert P.features('// Written by hand; the old generated version ("do not edit") is gone.\n' + OWN)[0] == 0.0
    assert P.features("// Finds files that carry an <auto-generated> banner and skips them.\n" + OWN)[0] == 0.0
    assert P.features(OWN.replace("F(1)", 'F("<auto-generated> code generated by X 1.0")'))[0] == 0.0
    assert P.features("// lib 2.4.7, upstream copy. See licence in the package.\n" + OWN)[2] == 1.0
    assert P.features(MIN)[1] > 0.9 and P.features(BLOB)[3] > 0.9
    assert P.features(OWN + "// " + "long comment " * 90)[1] == 0.0
    assert P.features(OWN.replace("F(1)", 'F("' + "word " * 90 + '")'))[1] == 0.0
    assert P.features("") == (0.0, 0.0, 0.0, 0.0, 0.0, None)
    assert P.features("// This file was generated by Foo 1.2 and counts rows\n" + OWN)[0] == 1.0
    assert P.features("// Counts files that were generated by Foo 1.2\n" + OWN)[0] == 0.0
    assert P.features("// No longer generated by Foo 1.2\n" + OWN)[0] == 0.0


def tables(spark):
    files = [(i, f"repo/src/P/F{i}.cs", "cs") for i in range(1, 31)]
    texts = [(i, OWN.replace("class A", f"class A{i}")) for i in range(1, 31)]
    more = [
        (101, "repo/vendor/lib/X.cs", "cs", "class X { }\n"), (102, "repo/vendor/lib/Y.cs", "cs", OWN.replace("Own.Core", "Lib.Internal")), (103, "repo/src/P/Z.cs", "cs", OWN.replace("Own.Core", "Lib.Internal")),
        (104, "repo/src/P/M.cs", "cs", MIN), (105, "repo/src/P/B.cs", "cs", BLOB), (106, "repo/src/P/G.g.cs", "cs", "// <auto-generated/>\n" + OWN), (107, "repo/Vendors/V.cs", "cs", OWN), (108, "repo/src/P/R.md", "md", MIN), (109, None, "cs", OWN), (110, "top.cs", "cs", None), (111, "repo/src/P/E.cs", "cs", ""),
    ]
    f = spark.createDataFrame([(*x, "h", 1) for x in files + [m[:3] for m in more] + files[:2]], "id long, path string, lang string, home string, e long")
    c = spark.createDataFrame([(*x, "k") for x in texts + [(m[0], m[3]) for m in more] + texts[:3]], "file_id long, content string, dir string")
    return f, c


def test_labels(spark):
    f, c = tables(spark)
    got = {r["file_id"]: r["label"] for r in P.labels(f, c).collect()}
    assert {k: v for k, v in got.items() if v != "handwritten"} == {101: "vendored", 102: "vendored", 103: "vendored", 104: "minified", 105: "blob", 106: "generated"}
    assert 108 not in got and got[109] == got[110] == got[111] == "handwritten"
    assert P.labels(f.limit(0), c.limit(0)).count() == 0
    assert P.labels(f, c.limit(0)).count() == len(got)


def test_belief_is_the_exact_marginal(spark):
    # one file under two directories: the sum over all labellings
    f = spark.createDataFrame([(1, "a/vendor/x.cs", "cs")], "id long, path string, lang string")
    c = spark.createDataFrame([(1, OWN)], "file_id long, content string")
    got = P.labels(f, c).first()
    e = [4.5, -2.0, 14 / (1 + math.exp(10)) - 2, -2.0, -2.0]
    plain, vendor = [1.0, 0, 0, 0, 0], [-2.0, 0, 0, 4.0, 0]
    w = lambda x, y: P.ALIKE if x == y else P.APART
    total = [0.0] * 5
    for x, y, z in itertools.product(range(5), repeat=3):
        total[x] += math.exp(e[x] + vendor[y] + plain[z] + w(x, y) + w(y, z))
    best = max(range(5), key=lambda k: total[k])
    assert got["label"] == P.LABELS[best] and abs(got["belief"] - total[best] / sum(total)) < 1e-9


def sources(spark, rows):
    """Tables of (path, root namespace, leading comment)."""
    f = spark.createDataFrame([(i, p, "cs") for i, (p, _, _) in enumerate(rows)], "id long, path string, lang string")
    c = spark.createDataFrame([(i, head + OWN.replace("Own.Core", f"{root}.Core").replace("class A", f"class A{i}")) for i, (_, root, head) in enumerate(rows)], "file_id long, content string")
    return f, c


def test_library_with_a_third_of_all_files(spark):
    rows = []
    for r in range(4):
        rows += [(f"r{r}/src/P{k % 4}/F{k}.cs", "Own", "") for k in range(40)]
        rows += [(f"r{r}/vendor/lib/d{k % 3}/L{k}.cs", "Lib", "// lib 2.4.7, upstream copy.\n" if k % 3 == 0 else "") for k in range(18)]
        rows += [(f"r{r}/src/P1/C{k}.cs", "Lib", "") for k in range(2)]
    # more copies than own files
    rows += [(f"q/src/P/F{k}.cs", "Own", "") for k in range(20)] + [(f"q/third_party/lib/L{k}.cs", "Lib", "") for k in range(60)]
    f, c = sources(spark, rows)
    got = {r["path"]: r["label"] for r in P.labels(f, c).collect()}
    assert {p for p, label in got.items() if label != "handwritten"} == {p for p, root, _ in rows if root == "Lib"}
    assert set(got.values()) == {"handwritten", "vendored"}


def test_small_repositories_with_roots_of_their_own(spark):
    rows = [(f"big/src/P{k % 4}/F{k}.cs", "Own", "") for k in range(90)]
    for r in range(1, 13):
        rows += [(f"small{r}/src/F{k}.cs", f"Root{r}", "") for k in range(r)]
        rows += [(f"small{r}/vendor/lib/L{k}.cs", "Lib", "") for k in range(2)]
    rows += [("small9/src/C.cs", "Lib", "")]
    f, c = sources(spark, rows)
    got = {r["path"]: r["label"] for r in P.labels(f, c).collect()}
    assert {p for p, label in got.items() if label != "handwritten"} == {p for p, root, _ in rows if root == "Lib"}

import itertools
import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import graph, search, symbols as S
from codeloom.sources.tables import Scratch

SYM = "id long, file_id long, parent_id long, kind string, name string, start_line int, end_line int"


def damerau_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) == 1 or len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]
    s, l = sorted((a, b), key=len)
    return any(l[:i] + l[i + 1 :] == s for i in range(len(l)))


def test_near_misses(spark):
    r = random.Random(0)
    names = list({"".join(r.choice("abc") for _ in range(r.randint(4, 6))) for _ in range(300)} | {"abdc", "abcde", "ABCD", "abxy"})
    df = spark.createDataFrame([(i, 1, None, "class", n, 1, 1) for i, n in enumerate(names)], SYM)
    got = {x["name"] for x in search.near_misses(df, "abcd").collect()}
    assert got == {n for n in names if n[:1].lower() == "a" and damerau_one(n.lower(), "abcd")}


def test_graded(spark):
    text = {1: ["foo bar", "bar x", "foo", "bar foo"], 2: ["foo", "nothing", "bar", "foo again"], 3: ["foo"], 4: ["food bar"]}
    lines = spark.createDataFrame([(f, k + 1, t) for f, ls in text.items() for k, t in enumerate(ls)], "file_id long, line_no int, line string")
    lines = lines.union(lines).where("file_id <= 2")
    got = {(r["file_id"], r["line_no"], r["tier"]) for r in search.graded(lines, "foo bar").collect()}
    assert got == {(1, 1, 0), (1, 4, 1), (2, 1, 2), (2, 3, 2)}
    assert {r["tier"] for r in search.graded(lines, "foo").collect()} == {1}


def test_innermost_and_reviewable(spark):
    rows = [(1, 1, None, "class", "A", 1, 30), (2, 1, 1, "method", "m", 3, 8), (3, 1, 1, "method", "n", 10, 20), (4, 1, 3, "method", "in", 12, 14), (5, 2, None, "class", "B", 5, 9), (6, 2, 5, "method", "q", 6, 7), (7, 1, None, "namespace", "N", 1, 40)]
    sy = spark.createDataFrame(rows, SYM)
    points = spark.createDataFrame([(f, n) for f in (1, 2) for n in range(1, 41)], "file_id long, line_no int")
    got = {(r["file_id"], r["line_no"]): r["symbol_id"] for r in S.innermost(points, sy).collect()}
    for f, n in itertools.product((1, 2), range(1, 41)):
        around = [r for r in rows if r[1] == f and r[5] <= n <= r[6]]
        best = min(around, key=lambda r: (r[6] - r[5], -r[5], r[0]), default=None)
        assert got.get((f, n)) == (best and best[0])
    ranges = spark.createDataFrame([(1, 13, 13), (2, 1, 50)], "file_id long, first int, last int")
    t = S.reviewable(S.intersecting(ranges, sy))
    assert {r["symbol_id"] for r in t.collect()} == {4, 5}


def test_uncovered(spark):
    t = spark.createDataFrame([("a", 1, 10), ("b", 1, 3), ("c", 2, 4)], "key string, first int, last int")
    c = spark.createDataFrame([("a", 2, 3), ("a", 5, 7), ("a", 6, 6), ("b", 0, 9)], "key string, first int, last int")
    got = {tuple(r) for r in S.uncovered(t, c).collect()}
    assert got == {("a", 1, 1), ("a", 4, 4), ("a", 8, 10), ("c", 2, 4)}


@pytest.mark.parametrize("seed", [1, 2])
def test_reachability(spark, seed):
    r = random.Random(seed)
    edges = list({(r.randrange(12), r.randrange(12)) for _ in range(22)})
    df = spark.createDataFrame(edges, "src long, dst long")
    roots = spark.createDataFrame([(0,), (5,)], "root long")
    got = {(x["root"], x["node"]): x["depth"] for x in graph.reachable(df, roots, Scratch(spark, "t")).collect()}
    want = {}
    for root in (0, 5):
        level, depth = {root}, 0
        while level:
            depth += 1
            level = {d for s, d in edges if s in level and (root, d) not in want}
            want.update({(root, d): depth for d in level})
    assert got == want


def test_paths_and_levels(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (1, 6), (6, 7), (7, 8), (8, 5), (9, 9), (10, 11), (11, 10)], "src long, dst long")
    s = Scratch(spark, "t")
    assert [r["path"] for r in graph.shortest_paths(e, 1, 5, 9, s).collect()] == [[1, 2, 4, 5], [1, 3, 4, 5]]
    assert [r["path"] for r in graph.shortest_paths(e, 1, 5, 1, s).collect()] == [[1, 2, 4, 5]]
    assert [r["path"] for r in graph.shortest_paths(e, 3, 3, 5, s).collect()] == [[3]]
    assert graph.shortest_paths(e, 5, 1, 5, s).count() == 0
    nodes = spark.createDataFrame([(n,) for n in range(1, 12)], "node long")
    got = {r["node"]: r["level"] for r in graph.levels(e, nodes, s).collect()}
    assert got == {5: 0, 4: 1, 2: 2, 3: 2, 8: 1, 7: 2, 6: 3, 1: 4, 9: 0, 10: None, 11: None}


def test_closure(spark):
    names = ["IDeep", "BaseHandler", "IDeepDerived", "MidHandler", "ViaInterface", "Leaf", "Other"]
    sy = spark.createDataFrame([(i, 1, None, "class", n, 1, 1) for i, n in enumerate(names)], SYM)
    be = spark.createDataFrame([("ideep", 0, 1, 1), ("ideep", 0, 2, 1), ("basehandler", 0, 3, 1), ("ideepderived", 0, 4, 1), ("midhandler", 0, 5, 1), ("leaf", 0, 5, 1)], "base_name string, base_arity int, derived_id long, file_id long")
    got = {r["symbol_id"]: r["depth"] for r in S.implementation_closure(be, sy, "ideep", Scratch(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 2, 5: 3}
    assert all(r["capped"] for r in S.implementation_closure(be, sy, "ideep", Scratch(spark, "t"), cap=2).collect())
    assert S.implementation_closure(be, sy, "nothing", Scratch(spark, "t")).count() == 0


def test_closure_tells_types_of_one_name_apart(spark):
    rows = [(1, "Box", 0), (2, "Box", 1), (3, "OfPlain", 0), (4, "OfGeneric", 0), (5, "Below", 0)]
    sy = spark.createDataFrame([(i, "class", n, a) for i, n, a in rows], "id long, kind string, name string, arity int")
    be = spark.createDataFrame([("iroot", 0, 2, 1), ("box", 0, 3, 1), ("box", 1, 4, 1), ("ofgeneric", 0, 5, 1)], "base_name string, base_arity int, derived_id long, file_id long")
    got = {r["symbol_id"]: r["depth"] for r in S.implementation_closure(be, sy, "IRoot", Scratch(spark, "t")).collect()}
    assert got == {2: 1, 4: 2, 5: 3}
    # of the root any number of arguments counts
    assert {r["symbol_id"] for r in S.implementation_closure(be, sy, "box", Scratch(spark, "t")).collect()} == {3, 4, 5}


def test_ancestors_end_on_cycles(spark):
    sy = spark.createDataFrame([(1, 1, 2, "c", "a", 1, 1), (2, 1, 1, "c", "b", 1, 1), (3, 1, 1, "c", "c", 1, 1), (4, 1, 77, "c", "d", 1, 1)], SYM)
    got = S.ancestors(sy, Scratch(spark, "t"), most=3)
    assert got.groupBy("symbol_id").count().orderBy("symbol_id").collect() == [(1, 3), (2, 3), (3, 3)]


def test_path_suggestions(spark):
    f = spark.createDataFrame([("a/b/X.cs",), ("q/b/X.cs",), ("a/b/Y.cs",), ("X.cs",)], "path string")
    assert [r["path"] for r in search.path_suggestions(f, "z/b/X.cs", 3).collect()] == ["a/b/X.cs", "q/b/X.cs", "X.cs"]
    assert F is not None

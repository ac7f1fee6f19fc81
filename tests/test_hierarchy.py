import random

import pytest

from codeloom.operators.hierarchy import contract, symbol_hierarchy
from codeloom.sources.tables import Scratch

SYMBOLS = "id long, file_id long, parent_id long, kind string, name string, container string"


def brute(parent):
    out = {}
    for x in parent:
        path, seen, at = [x], {x}, x
        while parent[at] is not None and parent[at] not in seen:
            at = parent[at]
            path.append(at)
            seen.add(at)
        out[x] = (at, len(path) - 1, path[::-1]) if parent[at] is None else (-1, -1, None)
    return out


def forest(seed, n):
    r = random.Random(seed)
    parent = {i: None if r.random() < 0.1 else r.choice([max(0, i - 1), r.randrange(n), max(0, i - 2)]) for i in range(n)}
    return parent


@pytest.mark.parametrize("parent", [{0: None}, {0: 0}, {0: 1, 1: 0}, {i: i - 1 if i else None for i in range(70)}, {i: 0 if i else None for i in range(60)}, forest(1, 80), forest(2, 150), {**{i: (i + 1) % 7 for i in range(7)}, 7: 3, 8: 7, 9: None, 10: 9}])
def test_contraction_equals_walking(spark, parent):
    rows = spark.createDataFrame([(k, v, f"n{k}") for k, v in parent.items()], "id long, parent long, name string")
    got = {r["id"]: r for r in contract(rows, Scratch(spark, "t"), full=True).collect()}
    want = brute(parent)
    assert set(got) == set(want)
    below = {x: 0 for x in parent}
    for x, (root, depth, path) in want.items():
        assert (got[x]["root"], got[x]["depth"]) == (root, depth)
        assert got[x]["path"] == ("/".join(f"n{p}" for p in path) if path else None)
        for p in (path or [])[:-1]:
            below[p] += 1
    # preorder intervals: the descendants of x, and nothing else
    by_root = {}
    for x, (root, _, path) in want.items():
        if path:
            assert got[x]["descendants"] == below[x]
            by_root.setdefault(root, []).append(x)
    for nodes in by_root.values():
        assert sorted(got[x]["preorder"] for x in nodes) == list(range(len(nodes)))
        for x in nodes:
            inside = {y for y in nodes if got[x]["preorder"] < got[y]["preorder"] <= got[x]["preorder"] + got[x]["descendants"]}
            assert inside == {y for y in nodes if y != x and x in want[y][2]}


def test_declared_parents_and_dirt(spark):
    rows = [
        (1, 1, None, "class", "A", None),
        (1, 1, None, "class", "A", None),  # repeated
        (2, 1, 99, "class", "B", "A"),  # parent is no symbol: the container decides
        (3, 1, None, "method", "m", "A.B"),
        (4, 2, None, "method", "x", "A"),  # another file
        (5, 1, 5, "method", "loop", None),
        (6, 1, 5, "method", "under", None),
        (None, 1, 1, "method", "no id", None),
        (7, None, None, None, None, None),
        (8, 1, None, "method", "n", "A.B"),
        (9, 1, None, "method", "n2", "A.C"),  # no such type
    ]
    df = spark.createDataFrame(rows, SYMBOLS).selectExpr("*", "1 as known", "2 as v", "3 as parent", "4 as root")
    got = {r["id"]: (r["root"], r["depth"]) for r in symbol_hierarchy(df).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (4, 0), 5: (-1, -1), 6: (-1, -1), 7: (7, 0), 8: (1, 2), 9: (9, 0)}


def test_empty(spark):
    assert symbol_hierarchy(spark.createDataFrame([], SYMBOLS)).count() == 0
    assert symbol_hierarchy(spark.createDataFrame([], SYMBOLS), full=True).count() == 0

import random

import pytest

from codeloom.operators import graph
from codeloom.operators.symbols import innermost, numbered
from codeloom.sources.tables import Scratch

r = random.Random(8)
GRAPHS = [[(r.randrange(9), r.randrange(9)) for _ in range(n)] for n in (0, 1, 6, 14, 30)] + [[(k, k + 1) for k in range(6)] + [(5, 2), (8, 8)]]


@pytest.mark.parametrize("edges", GRAPHS)
def test_one_task_and_joins_agree(spark, edges, monkeypatch):
    e = spark.createDataFrame(edges + edges[:2], "src long, dst long")
    roots = spark.createDataFrame([(0,), (3,), (3,), (None,), (99,)], "root long")
    nodes = spark.createDataFrame([(k,) for k in range(10)], "node long")
    got = []
    for small in (200_000, -1):
        monkeypatch.setattr(graph, "SMALL", small)
        s = Scratch(spark, "t")
        rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
        got.append((rows(graph.reachable(e, roots, s)), rows(graph.reachable(e, roots, s, 2)), rows(graph.levels(e, nodes, s)), [x[0] for x in graph.shortest_paths(e, 0, 4, 3, s).collect()]))
    assert got[0][:3] == got[1][:3] and sorted(got[0][3]) == sorted(got[1][3])


def test_innermost_over_blocks(spark):
    spans = [(k, 1, a := r.randrange(1, 9000), a + r.choice((0, 3, 63, 64, 500, 4095, 4096, 8000))) for k in range(120)] + [(900, 1, None, 5), (901, 2, 1, 10**6)]
    points = [(1, r.randrange(1, 12000)) for _ in range(200)] + [(2, 500_000), (3, 1)]
    want = {}
    for f, p in points:
        around = [(b - a, -a, i) for i, g, a, b in spans if g == f and a is not None and a <= p <= b]
        if around:
            want[f, p] = min(around)[2]
    s = spark.createDataFrame(spans, "id long, file_id long, start_line int, end_line int")
    got = {(x["file_id"], x["line_no"]): x["symbol_id"] for x in innermost(spark.createDataFrame(points, "file_id long, line_no int"), s).collect()}
    assert got == want


def test_numbered(spark):
    rows = [(r.randrange(50), k) for k in range(300)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(5)
    got = sorted(numbered(df, [df["a"].desc(), df["b"].asc()], Scratch(spark, "n")).collect(), key=lambda x: x["place"])
    assert [(x["a"], x["b"]) for x in got] == sorted(rows, key=lambda x: (-x[0], x[1])) and [x["place"] for x in got] == list(range(300))

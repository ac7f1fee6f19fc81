"""Project graphs: reachability, shortest paths, levels.

A graph whose size was counted and is small (`SMALL` edges) is walked in one task;
beyond that every loop is a chain of joins that cuts its lineage, counts while it
writes, and ends on a fixpoint. Both ways give the same rows.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, functions as F

from codeloom.sources.tables import Scratch

#: Edges, and edges times roots, that one task may walk.
SMALL, SMALL_WALKS = 200_000, 20_000_000


def counted(df: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """A table written, and how many rows were written; a retried task may count twice, so the number is at least that and 0 only if there are none."""
    seen = Observation()
    cut = scratch.cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return cut, seen.get["n"]


def _in_one_task(edges: DataFrame, starts: DataFrame | None, schema: str, walk: Callable[[list, list], Iterator[tuple]]) -> DataFrame:
    """`walk` over all edges and starts, which together are small."""
    both = edges.select("src", "dst", F.lit(True).alias("edge"))
    if starts is not None:
        # a start stands in both columns: a null would turn the column's numbers into floats
        both = both.unionByName(starts.select(F.col(starts.columns[0]).alias("src"), F.col(starts.columns[0]).alias("dst"), F.lit(False).alias("edge")))
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        links, heads = [], []
        for b in batches:
            for src, dst, edge in zip(b["src"].tolist(), b["dst"].tolist(), b["edge"].tolist()):
                links.append((src, dst)) if edge else heads.append(src)
        rows = list(walk(links, heads))
        for k in range(0, len(rows), 100_000):
            yield pd.DataFrame(rows[k : k + 100_000], columns=names)

    return both.coalesce(1).mapInPandas(run, schema)


def reachable(edges: DataFrame, roots: DataFrame, scratch: Scratch, most: int | None = None) -> DataFrame:
    """(root, node, depth): the nodes that each root reaches over one or more edges, and the fewest edges.

    `edges`: (src, dst); `roots`: (root). A root reaches itself only over a cycle.
    """
    e, n = counted(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), scratch)
    r, m = counted(roots.select("root").where("root is not null").distinct(), scratch)
    kind = dict(e.dtypes)["src"]
    if n <= SMALL and n * m <= SMALL_WALKS:

        def walk(links: list, heads: list) -> Iterator[tuple]:
            out = defaultdict(list)
            for a, b in links:
                out[a].append(b)
            for root in heads:
                seen: dict = {}
                front = deque([(root, 0)])
                while front:
                    at, depth = front.popleft()
                    if depth == most:
                        continue
                    for b in out.get(at, ()):
                        if b not in seen:
                            seen[b] = depth + 1
                            front.append((b, depth + 1))
                yield from ((root, node, depth) for node, depth in seen.items())

        return scratch.cut(_in_one_task(e, r, f"root {kind}, node {kind}, depth int", walk))
    seen = frontier = scratch.cut(r.join(e, r["root"] == e["src"]).select("root", F.col("dst").alias("node"), F.lit(1).alias("depth")).distinct())
    depth = 1
    while most is None or depth < most:
        depth += 1
        step = frontier.join(e, frontier["node"] == e["src"]).select("root", F.col("dst").alias("node")).distinct()
        frontier, n = counted(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), scratch)
        if not n:
            break
        seen = seen.unionByName(frontier)
    return seen


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def shortest_paths(edges: DataFrame, source: int, target: int, most: int, scratch: Scratch) -> DataFrame:
    """(path): up to `most` of the paths of the least length, in order; `[x]` from x to itself.

    Distances to the target first, then only edges that come one nearer.
    """
    spark = edges.sparkSession
    if source == target:
        return spark.createDataFrame([([source],)], "path array<long>")
    e, n = counted(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), scratch)
    if n <= SMALL:

        def walk(links: list, heads: list) -> Iterator[tuple]:
            back, out = defaultdict(list), defaultdict(list)
            for a, b in links:
                back[b].append(a)
                out[a].append(b)
            dist = {target: 0}
            front = deque([target])
            while front:
                at = front.popleft()
                for a in back.get(at, ()):
                    if a not in dist:
                        dist[a] = dist[at] + 1
                        front.append(a)
            if source not in dist:
                return
            left = most
            stack = [[source]]
            while stack and left:
                path = stack.pop()
                if path[-1] == target:
                    left -= 1
                    yield (path,)
                    continue
                near = [b for b in out[path[-1]] if dist.get(b, -1) == dist[path[-1]] - 1]
                stack += [[*path, b] for b in sorted(near, reverse=True)]

        return scratch.cut(_in_one_task(e, None, "path array<bigint>", walk))
    to = reachable(reverse(e), spark.createDataFrame([(target,)], "root long"), scratch)
    dist = scratch.cut(to.where(F.col("node") != target).select(F.col("node").alias("n"), "depth"))
    first = dist.where(F.col("n") == source).select("depth").first()
    if not first:
        return spark.createDataFrame([], "path array<long>")
    near = dist.unionByName(spark.createDataFrame([(target, 0)], "n long, depth int"))
    a = near.select(F.col("n").alias("src"), F.col("depth").alias("src_depth"))
    b = near.select(F.col("n").alias("dst"), F.col("depth").alias("dst_depth"))
    down = scratch.cut(e.join(a, "src").join(b, "dst").where("dst_depth = src_depth - 1").select("src", "dst"))
    paths = spark.createDataFrame([([source], source)], "path array<long>, at long")
    for _ in range(first["depth"]):
        # a bound on rows while the paths grow; order makes it the same rows each time
        paths = scratch.cut(paths.join(down, paths["at"] == down["src"]).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at")).orderBy("path").limit(most))
    return paths.select("path")


def levels(edges: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, level): topological levels, the longest way to a node without dependencies; nodes on or above cycles have null."""
    e, n = counted(edges.where("src <> dst").select("src", "dst").distinct(), scratch)
    left, m = counted(nodes.select("node").where("node is not null").distinct(), scratch)
    kind = dict(e.dtypes)["src"]
    if n <= SMALL and m <= SMALL:

        def walk(links: list, heads: list) -> Iterator[tuple]:
            known = set(heads)
            needs = dict.fromkeys(heads, 0)
            above = defaultdict(list)
            for a, b in links:
                if a in known and b in known:
                    needs[a] += 1
                    above[b].append(a)
            level = {x: 0 for x, k in needs.items() if not k}
            front = deque(level)
            while front:
                at = front.popleft()
                for a in above[at]:
                    needs[a] -= 1
                    if not needs[a]:  # nodes come in order of their levels, so the last one needed is a farthest one
                        level[a] = level[at] + 1
                        front.append(a)
            yield from ((x, level.get(x)) for x in heads)

        found = _in_one_task(e, left, f"node {kind}, level double", walk)
        return scratch.cut(found.select("node", F.col("level").cast("int").alias("level")))
    out = None
    level = 0
    while True:
        open_ = e.join(left.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        ready, n = counted(left.join(open_, "node", "left_anti").withColumn("level", F.lit(level)), scratch)
        if not n:
            break
        out = ready if out is None else out.unionByName(ready)
        left = scratch.cut(left.join(ready.select("node"), "node", "left_anti"))
        level += 1
    rest = left.withColumn("level", F.lit(None).cast("int"))
    return rest if out is None else out.unionByName(rest)

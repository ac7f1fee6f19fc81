"""Symbols: ranked search, spans, hierarchies, implementers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.functions.text import fold, fold_text
from codeloom.operators import graph
from codeloom.operators.store import TYPE_KINDS
from codeloom.sources.tables import Scratch


def name_match(name: Column, query: str, mode: str) -> Column:
    """Whether a name matches exactly, as a prefix or as a substring, ASCII-folded."""
    q, f = fold_text(query), fold(name)
    return {"exact": f == q, "prefix": f.startswith(q), "substring": f.contains(q)}[mode]


def namespace_subtree(ns: Column, root: str) -> Column:
    """Whether a namespace is `root` or below it, ASCII-folded."""
    q, f = fold_text(root), fold(ns)
    return (f == q) | f.startswith(q + ".")


def search(symbols: DataFrame, files: DataFrame, query: str, limit: int, offset: int = 0) -> DataFrame:
    """Symbols whose name holds the query, ranked: how well it matches, types first among exact ones, hand-written first, short names first."""
    f = files.select(F.col("id").alias("f_id"), "path", "is_generated")
    exact, prefix = name_match(F.col("name"), query, "exact"), name_match(F.col("name"), query, "prefix")
    hit = symbols.where(name_match(F.col("name"), query, "substring")).join(f, F.col("file_id") == F.col("f_id"))
    ranked = hit.select(
        F.col("id").alias("symbol_id"), "name", "kind", "path",
        F.when(exact, 0).when(prefix, 1).otherwise(2).alias("match_class"),
        F.when(exact & F.col("kind").isin(*TYPE_KINDS), 0).when(exact, 1).otherwise(2).alias("type_class"),
        F.col("is_generated").cast("int").alias("generated"),
    )
    return ranked.orderBy("match_class", "type_class", "generated", F.length("name"), "name", "path", "symbol_id").offset(offset).limit(limit)


def best_match_class(symbols: DataFrame, query: str) -> DataFrame:
    """The auto ladder in one job: only the matches of the best class that has any."""
    exact, prefix = name_match(F.col("name"), query, "exact"), name_match(F.col("name"), query, "prefix")
    hit = symbols.where(name_match(F.col("name"), query, "substring")).withColumn("match_class", F.when(exact, 0).when(prefix, 1).otherwise(2))
    best = hit.agg(F.min("match_class").alias("best"))
    return hit.join(F.broadcast(best), hit["match_class"] == best["best"]).drop("best")


#: Lines of a block; spans of more than its square are blocked by the square.
FINE = 64


def innermost(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, line_no, symbol_id): of the spans around each point the shortest, then the latest to start, then the least id.

    Spans are cut into aligned blocks of 64 lines and joined on file and block; a
    span of many blocks is one row for each, but of 4096 lines at most: longer ones
    stand in a second, coarser grid. So a point meets the spans of its own
    stretch of the file only, and a large generated file is many small keys. The
    best is a map-side minimum; no window over unbounded groups.
    """
    s = symbols.where("start_line is not null and end_line is not null").select(F.col("id").alias("symbol_id"), F.col("file_id").alias("s_file"), "start_line", "end_line")
    p = points.select("file_id", "line_no").distinct()
    wide = F.col("end_line") - F.col("start_line") >= FINE * FINE
    out = None
    for size, some in ((FINE, s.where(~wide)), (FINE * FINE, s.where(wide))):
        cells = some.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start_line") / size), F.floor(F.col("end_line") / size))))
        j = p.withColumn("p_cell", F.floor(F.col("line_no") / size)).join(cells, (F.col("file_id") == F.col("s_file")) & (F.col("p_cell") == F.col("cell")) & F.col("line_no").between(F.col("start_line"), F.col("end_line")))
        j = j.select("file_id", "line_no", F.struct((F.col("end_line") - F.col("start_line")).alias("span"), (-F.col("start_line")).alias("late"), F.col("symbol_id")).alias("k"))
        out = j if out is None else out.unionByName(j)
    return out.groupBy("file_id", "line_no").agg(F.min("k")["symbol_id"].alias("symbol_id"))


def intersecting(ranges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, first, last, symbol_id): spans that share a line with each range."""
    s = symbols.select(F.col("id").alias("symbol_id"), F.col("file_id").alias("s_file"), "start_line", "end_line", "kind", "parent_id")
    return ranges.join(s, (ranges["file_id"] == s["s_file"]) & (s["start_line"] <= ranges["last"]) & (s["end_line"] >= ranges["first"])).drop("s_file")


def reviewable(touched: DataFrame) -> DataFrame:
    """Of the touched spans of each range those to review: no namespaces, no members of a type that the range covers whole, no parent that it covers in part if a child is touched."""
    t = touched.where("kind <> 'namespace'").withColumn("whole", (F.col("first") <= F.col("start_line")) & (F.col("last") >= F.col("end_line")))
    key = ["file_id", "first", "last"]
    swallow = t.where(F.col("whole") & F.col("kind").isin(*TYPE_KINDS)).select(*key, F.col("symbol_id").alias("parent_id"))
    kept = t.join(swallow, [*key, "parent_id"], "left_anti")
    parents = kept.where("parent_id is not null").select(*key, F.col("parent_id").alias("symbol_id")).distinct()
    partly = kept.where("not whole").join(parents, [*key, "symbol_id"], "left_anti")
    return kept.where("whole").unionByName(partly.select(*kept.columns))


def uncovered(targets: DataFrame, covers: DataFrame) -> DataFrame:
    """(key, first, last): the gaps of each target interval that no cover touches."""
    c = covers.select(F.col("key").alias("c_key"), F.col("first").alias("c_first"), F.col("last").alias("c_last"))
    j = targets.join(c, (targets["key"] == c["c_key"]) & (c["c_first"] <= targets["last"]) & (c["c_last"] >= targets["first"]))
    marks = j.select("key", "first", "last", F.greatest("c_first", "first").alias("a"), F.least("c_last", "last").alias("b"))
    # a cover before the first and one behind the last line close the ends
    ends = targets.select("key", "first", "last", (F.col("first") - 1).alias("a"), (F.col("first") - 1).alias("b")).unionByName(targets.select("key", "first", "last", (F.col("last") + 1).alias("a"), (F.col("last") + 1).alias("b")))
    w = Window.partitionBy("key", "first", "last").orderBy("a", "b")
    seen = marks.unionByName(ends).withColumn("far", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return seen.where(F.col("a") > F.col("far") + 1).select("key", (F.col("far") + 1).alias("gap_first"), (F.col("a") - 1).alias("gap_last"))


def ancestors(symbols: DataFrame, scratch: Scratch, most: int = 16) -> DataFrame:
    """(symbol_id, ancestor_id, hops) by parent links, at most `most` hops: a bounded walk, so cycles end."""
    edge = symbols.where("parent_id is not null").select(F.col("id").alias("e_id"), F.col("parent_id").alias("e_parent"))
    known = symbols.select(F.col("id").alias("k_id"))
    edge = scratch.cut(edge.join(known, edge["e_parent"] == known["k_id"], "left_semi").distinct())
    level = edge.select(F.col("e_id").alias("symbol_id"), F.col("e_parent").alias("ancestor_id"), F.lit(1).alias("hops"))
    out = level
    for hops in range(2, most + 1):
        level = scratch.cut(level.join(edge, level["ancestor_id"] == edge["e_id"]).select("symbol_id", F.col("e_parent").alias("ancestor_id"), F.lit(hops).alias("hops")))
        if not level.limit(1).count():
            break
        out = out.unionByName(level)
    return out


def implementers(base_edges: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """Types whose base list names `name`, ASCII-folded."""
    e = base_edges.where(F.col("base_name") == fold_text(name))
    return symbols.join(e.select(F.col("derived_id").alias("id")), "id", "left_semi")


def implementation_closure(base_edges: DataFrame, symbols: DataFrame, name: str, scratch: Scratch, cap: int = 2000) -> DataFrame:
    """(symbol_id, depth, capped) of all types that derive from `name` over any number of hops.

    Breadth first over folded names with their number of type arguments; of the
    root's any number counts. `capped` tells,
    instead of cutting silently, that more than `cap` were found.
    """
    # symbols that come without their number of type parameters have none
    arity = F.coalesce("arity", F.lit(0)) if "arity" in symbols.columns else F.lit(0)
    types = symbols.where(F.col("kind").isin(*TYPE_KINDS)).select(F.col("id").alias("t_id"), F.concat_ws("`", fold("name"), arity.cast("string")).alias("own"))
    named = base_edges.join(types, base_edges["derived_id"] == types["t_id"]).select("base_name", F.concat_ws("`", "base_name", F.col("base_arity").cast("string")).alias("base"), "derived_id", "own").distinct()
    e = scratch.cut(named)
    spark = symbols.sparkSession
    # the root stands for the name with any number of arguments; it is no name itself
    start = e.where(F.col("base_name") == fold_text(name)).select(F.lit("").alias("src"), F.col("base").alias("dst"))
    root = spark.createDataFrame([("",)], "root string")
    near = graph.reachable(e.select(F.col("base").alias("src"), F.col("own").alias("dst")).unionByName(start), root, scratch).select(F.col("node").alias("at"), "depth")
    # a type is as deep as the shallowest of the names that it derives from
    found = scratch.cut(e.join(near, e["base"] == near["at"]).groupBy("derived_id").agg(F.min("depth").alias("depth")))
    n = found.agg((F.count("*") > cap).alias("capped"))
    return found.select(F.col("derived_id").alias("symbol_id"), "depth").crossJoin(F.broadcast(n))


def fingerprint(*parts: Column | str) -> Column:
    """A short stable handle of an identity."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 12)


def numbered(rows: DataFrame, order: list[Column], scratch: Scratch) -> DataFrame:
    """Rows with `place`, counted from 0 in a total order."""
    return running_total(rows.withColumn("one", F.lit(1).cast("long")), order, "one", scratch).withColumn("place", F.col("running") - 1).drop("one", "running")


def running_total(rows: DataFrame, order: list[Column], value: str, scratch: Scratch) -> DataFrame:
    """Rows with `running`, the sum of a column up to and with each row in a total order.

    Rows are sorted into ranges, each a task; sums run within a range and begin
    where the totals of the ranges before it end. No window holds more than a range.
    """
    cut = scratch.cut(rows.orderBy(*order).withColumn("range", F.spark_partition_id()).withColumn("within", F.monotonically_increasing_id()))
    # one row a range: bounded by the number of partitions
    n = cut.groupBy("range").agg(F.sum(value).alias("n"))
    base = n.select(F.col("range").alias("b_range"), F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = Window.partitionBy("range").orderBy("within").rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumn("sum", F.sum(value).over(inner))
    return summed.join(F.broadcast(base), summed["range"] == base["b_range"]).withColumn("running", F.col("base") + F.col("sum")).drop("range", "within", "b_range", "base", "sum")

"""Parent-child rows to full hierarchies by parallel tree contraction.

The operator never walks the trees level by level. Each round rakes all leaves
and splices an independent set of unary-chain nodes, so a bushy tree ends after
as many rounds as it is high and a chain of n nodes after O(log n) rounds. What
a round removes is recorded; replaying the records backwards yields root,
depth, path, subtree size and preorder place of every node. A core that neither
rule can shrink further is a set of self-loops: the contracted cycles.

Defined results:
* a null id is no node; rows of one id count once (the smallest row wins);
* a null parent, or a parent that is no node, makes a root;
* a node on a cycle, or below one, has root -1 and depth -1 and no path;
* empty input gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from codeloom.sources.tables import Scratch

TYPE_KINDS = ("class", "interface", "struct", "record", "enum", "module")


def declared_parents(symbols: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, parent, name) of symbols: `parent_id` if it exists, otherwise the type
    of the same file whose dotted name is the symbol's container, otherwise null.

    Several types of one file under one dotted name: the smallest id is taken.
    """
    s = (
        symbols.where("id is not null")
        .select(
            "id",
            F.struct(
                F.col("parent_id").cast("long").alias("parent_id"),
                F.col("file_id").cast("long").alias("file_id"),
                "container",
                "name",
                F.col("kind").isin(*TYPE_KINDS).alias("is_type"),
            ).alias("v"),
        )
        .groupBy("id")
        .agg(F.min("v").alias("v"))
        .select("id", "v.*")
    )
    s = scratch.cut(s)
    ids = s.select(F.col("id").alias("known"))
    # Null parents stay out of the join: they would all meet in one partition.
    named = s.where("parent_id is not null").select("id", "parent_id", "file_id", "container", "name")
    tried = scratch.cut(
        named.join(ids, named["parent_id"] == ids["known"], "left").select("id", F.col("known").alias("parent"), "file_id", "container", "name")
    )
    rest = tried.where("parent is null").select("id", "file_id", "container", "name").unionByName(
        s.where("parent_id is null").select("id", "file_id", "container", "name")
    )
    types = (
        s.where("is_type and name is not null and file_id is not null")
        .select(F.col("file_id").alias("t_file"), F.concat_ws(".", "container", "name").alias("t_name"), F.col("id").alias("t_id"))
        .groupBy("t_file", "t_name")
        .agg(F.min("t_id").alias("t_id"))
    )
    inside = rest.where("container is not null and file_id is not null")
    outside = rest.where("container is null or file_id is null")
    placed = inside.join(types, (inside["file_id"] == types["t_file"]) & (inside["container"] == types["t_name"]), "left").select(
        "id", F.col("t_id").alias("parent"), "name"
    )
    return (
        tried.where("parent is not null").select("id", "parent", "name")
        .unionByName(placed)
        .unionByName(outside.select("id", F.lit(None).cast("long").alias("parent"), "name"))
    )


def _coin(c: Column, turn: int) -> Column:
    return F.xxhash64(c, F.lit(turn))


def contract(parents: DataFrame, scratch: Scratch, full: bool = False) -> DataFrame:
    """Tree contraction over (id, parent[, name]), one row an id.

    Returns (id, root, depth) and, with `full`, also path (names joined by '/'),
    preorder (place in the preorder of the root's tree) and descendants (their
    number): the descendants of x are the nodes of x's root with a preorder in
    (x.preorder, x.preorder + x.descendants]. That relation has one row a node
    where a list of pairs would be quadratic on a deep chain.

    Columns while contracting: `w` edges to `parent`; with `full` also `label`
    (names below `parent`, down to the node) and `held` (size of what has been
    raked into the node, itself included).
    """
    extra = [F.coalesce("name", F.lit("")).alias("label"), F.lit(1).cast("long").alias("held"), F.lit(0).cast("long").alias("above")] if full else []
    cols = ["id", "parent", "w"] + (["label", "held", "above"] if full else [])
    live = scratch.cut(parents.select("id", "parent", F.lit(1).cast("long").alias("w"), *extra))
    rakes: list[DataFrame] = []
    splices: list[DataFrame] = []
    turn = 0
    while True:
        turn += 1
        # One pass over the children of each node: how many, and which if one.
        offers = live.where("parent is not null and parent <> id")
        kids = offers.groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("n"), F.max("id").alias("child"))
        seen = live.join(kids, live["id"] == kids["of"], "left")
        p_coin, c_coin, v_coin = _coin(F.col("parent"), turn), _coin(F.col("child"), turn), _coin(F.col("id"), turn)
        # On a contracted cycle of two, both neighbours are the same node; equal
        # hashes of different nodes splice neither, and the next turn rehashes.
        splice = F.col("n").eqNullSafe(1) & F.col("parent").isNotNull() & (F.col("parent") != F.col("id")) & (v_coin < p_coin) & (v_coin < c_coin)
        leaf = F.col("n").isNull() & F.col("parent").isNotNull() & (F.col("parent") != F.col("id"))
        # the write counts what it writes; a retried task may count twice, which does not matter to what is asked
        seen_acts = Observation()
        acts = seen.select(*cols, "child", F.when(leaf, 1).when(splice, 2).otherwise(0).alias("act"))
        open_ = F.col("parent").isNotNull() & (F.col("parent") != F.col("id"))
        state = scratch.cut(acts.observe(seen_acts, F.count_if(F.col("act") == 1).alias("raked"), F.count_if(F.col("act") == 2).alias("spliced"), F.count_if(open_).alias("open")))
        counts = seen_acts.get
        if not counts.get("raked") and not counts.get("spliced"):
            if not counts.get("open"):
                break
            # a chain or cycle is left that this turn's coins spared
            scratch.drop(live)
            live = state.select(*cols)
            continue
        gone = state.where("act = 1").select(*cols)
        kept = state.where("act <> 1")
        if full:
            gone, kept = _absorb(gone, kept, cols, scratch)
            # A chain node whose only child was raked just now is a leaf of the
            # next turn; the others record what stood above their child.
            child = kept.select(F.col("id").alias("c_id"), F.col("above").alias("c_above"))
            kept = scratch.cut(kept.join(child, (kept["act"] == 2) & (kept["child"] == child["c_id"]), "left").withColumn("act", F.when(F.col("c_id").isNotNull(), 2).otherwise(0)).drop("c_id"))
        spliced = kept.where("act = 2")
        kept = kept.where("act = 0").select(*cols)
        rakes.append(gone)
        if counts.get("spliced"):
            spliced = spliced.select(*cols, "child", *(["c_above"] if full else []))
            splices.append(spliced)
            via = spliced.select(F.col("id").alias("s_id"), F.col("parent").alias("s_parent"), F.col("w").alias("s_w"), *([F.col("label").alias("s_label"), F.col("held").alias("s_held"), F.col("above").alias("s_above")] if full else []))
            j = kept.join(via, kept["parent"] == via["s_id"], "left")
            hop = F.col("s_id").isNotNull()
            out = [
                F.col("id"),
                F.when(hop, F.col("s_parent")).otherwise(F.col("parent")).alias("parent"),
                F.when(hop, F.col("w") + F.col("s_w")).otherwise(F.col("w")).alias("w"),
            ]
            if full:
                out += [
                    F.when(hop, F.concat_ws("/", "s_label", "label")).otherwise(F.col("label")).alias("label"),
                    F.col("held"),
                    # what stands before this node inside the slot it took over
                    F.when(hop, F.col("above") + F.col("s_above") + F.col("s_held")).otherwise(F.col("above")).alias("above"),
                ]
            kept = scratch.cut(j.select(*out))
        else:
            splices.append(None)
        # without a splice what is kept is only filtered out of the written state
        scratch.drop(live)
        live = kept
    # What is left: roots (null parent) and self-loops, which stand for cycles.
    done = live.select(
        "id",
        F.when(F.col("parent").isNull(), F.col("id")).otherwise(F.lit(-1)).cast("long").alias("root"),
        F.when(F.col("parent").isNull(), F.lit(0)).otherwise(F.lit(-1)).cast("long").alias("depth"),
        *([F.when(F.col("parent").isNull(), F.col("label")).alias("path"), F.when(F.col("parent").isNull(), F.lit(0)).cast("long").alias("preorder"), F.when(F.col("parent").isNull(), F.col("held")).alias("size")] if full else []),
    )
    parts = [done]
    for gone, spliced in zip(reversed(rakes), reversed(splices)):
        # a raked leaf may hang on a node that was spliced in the same round
        if spliced is not None:
            found = _replay(spliced, done, full, True)
            # in the plain mode spliced nodes are few and their join is cheap to run twice; one write a round is saved
            found = scratch.cut(found) if full else found
            fresh = _union([found, _replay(gone, _union([done, found]), full, False)])
        else:
            fresh = _replay(gone, done, full, False)
        parts.append(scratch.cut(fresh))
        done = _union(parts)
    if full:
        done = done.withColumn("descendants", F.col("size") - 1).drop("size")
    return done


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _absorb(gone: DataFrame, kept: DataFrame, cols: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Gives each raked leaf its place behind what its parent already holds.

    The place is a running sum of sizes among the leaves of one parent. A parent
    with very many leaves would put them into one window task, so the sum is
    taken in two steps: inside hashed slices of the parent, then over slices.
    """
    from pyspark.sql import Window

    g = gone.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(256)))
    own = F.col("held") + F.col("above")
    inner = Window.partitionBy("parent", "slice").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("parent").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = g.groupBy("parent", "slice").agg(F.sum(own).alias("n"))
    slices = scratch.cut(slices.select("parent", "slice", "n", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("base")))
    placed = g.withColumn("run", F.coalesce(F.sum(own).over(inner), F.lit(0))).join(slices.drop("n"), ["parent", "slice"])
    totals = slices.groupBy(F.col("parent").alias("t_parent")).agg(F.sum("n").alias("t_n"))
    k = kept.join(totals, kept["id"] == totals["t_parent"], "left")
    slot = kept.select(F.col("id").alias("k_id"), F.col("held").alias("k_held"))
    placed = placed.join(slot, placed["parent"] == slot["k_id"], "left")
    gone = scratch.cut(placed.select(*cols, (F.coalesce("k_held", F.lit(0)) + F.col("base") + F.col("run")).alias("at")))
    rest = [c for c in kept.columns if c not in ("held",)]
    kept = scratch.cut(k.select(*rest, (F.col("held") + F.coalesce("t_n", F.lit(0))).alias("held")))
    return gone, kept


def _replay(records: DataFrame, done: DataFrame, full: bool, chain: bool) -> DataFrame:
    """Results of recorded nodes from those of the nodes they were put under."""
    up = done.select(F.col("id").alias("u_id"), F.col("root").alias("u_root"), F.col("depth").alias("u_depth"), *([F.col("path").alias("u_path"), F.col("preorder").alias("u_pre")] if full else []))
    j = records.join(up, records["parent"] == up["u_id"], "left")
    bad = F.col("u_root").isNull() | (F.col("u_root") == -1)
    out = [
        F.col("id"),
        F.when(bad, F.lit(-1)).otherwise(F.col("u_root")).cast("long").alias("root"),
        F.when(bad, F.lit(-1)).otherwise(F.col("u_depth") + F.col("w")).cast("long").alias("depth"),
    ]
    if not full:
        return j.select(*out)
    out.append(F.when(~bad, F.concat_ws("/", "u_path", "label")).alias("path"))
    if not chain:
        # the node's own subtree is complete when it is raked
        return j.select(*out, F.when(~bad, F.col("u_pre") + F.col("at") + F.col("above")).cast("long").alias("preorder"), F.when(~bad, F.col("held")).cast("long").alias("size"))
    # A spliced node lies before what stood above its chain child at that time.
    below = done.select(F.col("id").alias("b_id"), F.col("preorder").alias("b_pre"), F.col("size").alias("b_size"))
    j = j.join(below, j["child"] == below["b_id"], "left")
    return j.select(*out, F.when(~bad, F.col("b_pre") - F.col("c_above") - F.col("held")).cast("long").alias("preorder"), F.when(~bad, F.col("held") + F.col("c_above") + F.col("b_size")).cast("long").alias("size"))


def symbol_hierarchy(symbols: DataFrame, full: bool = False) -> DataFrame:
    """Hierarchy of a symbols table: id, root, depth and with `full` the rest of `contract`."""
    scratch = Scratch(symbols.sparkSession, "hierarchy")
    return contract(declared_parents(symbols, scratch), scratch, full)

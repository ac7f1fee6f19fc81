"""References to records that do not exist, by a Bloom filter and an exact join.

The keys of all parent records fill a blocked Bloom filter built from built-in
expressions (bitmap_construct_agg, one 4 KiB block a row). Its size follows from
the number of keys and is capped, so it may be broadcast; beyond the cap only
the false-positive rate grows. A reference the filter denies is a definite
orphan and never meets the parents; the others are verified by an exact join,
so the result is exact at any rate.

Defined results: null, blank and repeated references are dropped; null keys are
no parents; an owner without time yields a null period and is never 'late';
empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BLOCK_BITS = 32768
PROBES = 4


def normal_path(path: Column) -> Column:
    """One form of paths that differ in case, separators, blanks and empty, `.` or `..` segments."""
    segments = F.split(F.lower(F.regexp_replace(path, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[/\\]")
    kept = F.filter(segments, lambda s: (s != "") & (s != "."))
    folded = F.aggregate(
        kept,
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, -1), F.lit("..")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    # only paths with a `..` need the fold
    return F.when(F.exists(kept, lambda s: s == ".."), F.concat_ws("/", folded)).otherwise(F.concat_ws("/", kept))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BLOCK_BITS)).cast("int") for i in range(1, PROBES + 1)]


def bloom_filter(keys: DataFrame, key: str, max_bytes: int = 8 << 20) -> tuple[DataFrame, int]:
    """A blocked Bloom filter (block, bitmap) of a key column and its number of blocks.

    About 12 bits a key; at most `max_bytes`, which bounds what is broadcast.
    """
    n = keys.agg(F.approx_count_distinct(key, 0.05)).first()[0]
    blocks = max(1, min(-(-n * 12 // BLOCK_BITS), max_bytes // (BLOCK_BITS // 8)))
    bits = keys.where(F.col(key).isNotNull()).select(_block(F.col(key), blocks).alias("block"), F.explode(F.array(*_bits(F.col(key)))).alias("bit"))
    return bits.groupBy("block").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap")), blocks


def may_contain(df: DataFrame, key: str, filter_: tuple[DataFrame, int]) -> DataFrame:
    """`df` with `maybe`: false proves that the key is in no parent record."""
    blocks, n = filter_
    df = df.withColumn("_block", _block(F.col(key), n))
    j = df.join(F.broadcast(blocks), df["_block"] == blocks["block"], "left")
    # byte of the bitmap as a number, then the bit
    hits = [
        F.expr("conv(hex(substring(bitmap, cast({0} div 8 as int) + 1, 1)), 16, 10)".format(f"bit{i}")).cast("int").bitwiseAND(F.expr(f"shiftleft(1, bit{i} % 8)")) != 0
        for i in range(PROBES)
    ]
    for i, b in enumerate(_bits(F.col(key))):
        j = j.withColumn(f"bit{i}", b)
    every = hits[0]
    for h in hits[1:]:
        every = every & h
    return j.withColumn("maybe", F.coalesce(every, F.lit(False))).drop("_block", "block", "bitmap", *[f"bit{i}" for i in range(PROBES)])


def references(projects: DataFrame, solutions: DataFrame) -> DataFrame:
    """(owner_kind, owner_id, owner_at, ref_path, key), distinct: what live projects and all solutions refer to."""
    p = projects.where("removed_at is null").select(F.lit("project").alias("owner_kind"), F.col("id").alias("owner_id"), F.col("parsed_at").alias("owner_at"), F.explode("project_ref_rel_paths").alias("ref_path"))
    s = solutions.select(F.lit("solution").alias("owner_kind"), F.col("id").alias("owner_id"), F.col("parsed_at").alias("owner_at"), F.explode("project_rel_paths").alias("ref_path"))
    named = p.unionByName(s).where(F.col("ref_path").rlike(r"[^\s\p{Z}]"))
    return named.distinct().withColumn("key", normal_path(F.col("ref_path")))


def orphans(projects: DataFrame, solutions: DataFrame) -> DataFrame:
    """(owner_kind, owner_id, ref_path, state, period) of references without a usable project record."""
    refs = references(projects, solutions)
    parents = projects.where("rel_path is not null").select(normal_path(F.col("rel_path")).alias("p_key"), "parsed_at", "removed_at")
    checked = may_contain(refs, "key", bloom_filter(parents, "p_key"))
    definite = checked.where(~F.col("maybe")).withColumn("state", F.lit("missing"))
    known = parents.groupBy("p_key").agg(F.min("parsed_at").alias("first_at"), F.min(F.col("removed_at").isNotNull()).alias("gone"))
    maybe = checked.where("maybe")
    verified = maybe.join(known, maybe["key"] == known["p_key"], "left").withColumn(
        "state",
        F.when(F.col("p_key").isNull(), "missing").when(F.col("gone"), "deleted").when(F.col("first_at") > F.col("owner_at"), "late"),
    )
    cols = ["owner_kind", "owner_id", "ref_path", "state", F.date_format("owner_at", "yyyy-MM").alias("period")]
    return definite.select(*cols).unionByName(verified.where("state is not null").select(*cols)).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphan references per owner table, month and state."""
    return found.groupBy("owner_kind", "period", "state").agg(F.count("*").alias("references"), F.count_distinct("owner_id").alias("owners"))

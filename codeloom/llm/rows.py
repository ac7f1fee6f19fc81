"""One text for each id without moving the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.sources.tables import Scratch


def one_text_each(documents: DataFrame, id_col: str, text_col: str, scratch: Scratch, id_type: str = "long") -> DataFrame:
    """(i, s): one row an id; of different texts under one id the greatest counts, null texts being the least.

    Only ids are shuffled to find those with several rows; the texts of these
    few meet, all others are scanned where they are. The table of repeated ids
    is written, so that the planner knows its size and moves the texts only if it
    is too large to be broadcast.
    """
    d = spread(documents.select(F.col(id_col).cast(id_type).alias("i"), F.col(text_col).alias("s")))
    many = scratch.cut(d.groupBy(F.col("i").alias("m")).agg(F.count("*").alias("n")).where("n > 1").select("m", F.lit(True).alias("hit")))
    if many.isEmpty():
        return d
    single = d.join(many, d["i"].eqNullSafe(many["m"]), "left_anti")
    several = d.join(many, d["i"].eqNullSafe(many["m"]), "left_semi").groupBy("i").agg(F.max("s").alias("s"))
    return single.unionByName(several)


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan over at least as many tasks as there are cores.

    Python work on a text is worth far more than moving it once, but only where
    the files alone would leave cores idle: one small file is one task. Tables of
    many files are left as they are, and so is all that has been shuffled before.
    """
    plan = scan._jdf.queryExecution().executedPlan().toString()
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in plan or "FileScan" not in plan or scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores)


#: Stands for a null id inside Python batches: a null among numbers would make floats of them all, and large ids would lose their last digits.
NULL_ID = -(1 << 63)


def whole_id(c: Column | str) -> Column:
    """An id as a number that is never null."""
    return F.coalesce(F.col(c).cast("long") if isinstance(c, str) else c.cast("long"), F.lit(NULL_ID).cast("long"))


def own_id(c: str) -> Column:
    """The id that `whole_id` took."""
    return F.when(F.col(c) != F.lit(NULL_ID).cast("long"), F.col(c))

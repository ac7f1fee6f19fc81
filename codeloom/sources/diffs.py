"""Unified diffs as tables of changed line ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def hunks(diffs: DataFrame) -> DataFrame:
    """(diff_id, path, deleted, old_start, old_count, new_start, new_count) of unified diffs (diff_id, text).

    A file's part begins with `diff --git` and names its new path, or the old one
    where it is deleted; a count that is left out is 1. Text before the first part
    and hunks that do not read as such are left out; a part without hunks has none.
    All of it is expressions on one text; nothing is shuffled.
    """
    part = diffs.select("diff_id", F.explode(F.slice(F.split(F.concat(F.lit("\n"), "text"), r"\r?\ndiff --git "), 2, 1 << 30)).alias("part"))
    new, old = F.regexp_extract("part", r"(?m)^\+\+\+ b/([^\r\n]*)", 1), F.regexp_extract("part", r"(?m)^--- a/([^\r\n]*)", 1)
    deleted = F.col("part").rlike(r"(?m)^\+\+\+ /dev/null")
    each = part.select("diff_id", F.when(deleted, old).otherwise(new).alias("path"), deleted.alias("deleted"), F.explode(F.regexp_extract_all("part", F.lit(r"(?m)^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@"), F.lit(0))).alias("h"))
    n = lambda k: F.regexp_extract("h", r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", k)
    count = lambda k: F.when(n(k) == "", 1).otherwise(n(k).cast("int"))
    return each.where("path <> ''").select("diff_id", "path", "deleted", n(1).cast("int").alias("old_start"), count(2).alias("old_count"), n(3).cast("int").alias("new_start"), count(4).alias("new_count"))


def ranges(hunk: DataFrame, most: int = 64) -> DataFrame:
    """(diff_id, path, first, last): the changed lines of each new file, one row a hunk; a file of more than `most` hunks is one range over all (last null), as is a deletion of lines at their place."""
    w = hunk.where("not deleted").groupBy("diff_id", "path").agg(F.count("*").alias("n"), F.collect_list(F.struct("new_start", "new_count")).alias("h"))
    many = w.where(F.col("n") > most).select("diff_id", "path", F.lit(1).alias("first"), F.lit(None).cast("int").alias("last"))
    few = w.where(F.col("n") <= most).select("diff_id", "path", F.explode("h").alias("h"))
    few = few.select("diff_id", "path", F.col("h.new_start").alias("first"), (F.col("h.new_start") + F.greatest(F.col("h.new_count"), F.lit(1)) - 1).alias("last"))
    return few.unionByName(many)

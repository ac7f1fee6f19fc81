"""Operational event records: normalisation, latest state, retention, keyset pages, rates."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

# fixed values: what a result says of an operation
OUTCOMES = {"exact": ("success", "exact"), "partial": ("success", "partial"), "degraded": ("degraded", "indexed"), "unresolved": ("failed", "none"), "error": ("failed", "none")}


def normalise(lines: DataFrame) -> DataFrame:
    """JSON lines (value) as typed records; a line that is no object, or has no type, counts as 'invalid'."""
    schema = "e string, ts string, corr string, tool string, accessMode string, result string, reason string, cold boolean, clusterLoadMs double, queryMs double, count long, capBytes long, buildId string, state string, phase string, filesDone long, elapsedMs double, version string"
    j = lines.select("value", F.from_json("value", schema).alias("j"))
    kind = F.coalesce(F.col("j.e"), F.lit("invalid"))
    outcome, confidence = F.lit(None).cast("string"), F.lit(None).cast("string")
    for result, (o, c) in OUTCOMES.items():
        outcome = F.when(F.col("j.result") == result, o).otherwise(outcome)
        confidence = F.when(F.col("j.result") == result, c).otherwise(confidence)
    took = F.coalesce("j.clusterLoadMs", F.lit(0.0)) + F.coalesce("j.queryMs", F.lit(0.0))
    at = F.to_timestamp("j.ts")
    return j.select(
        kind.alias("kind"), at.alias("emitted_at"),
        F.when(kind == "semanticOp", F.timestamp_micros(F.unix_micros(at) - (F.round(took) * 1000).cast("long"))).alias("started_at"),
        F.col("j.corr").alias("correlation_id"), F.col("j.tool").alias("tool"), outcome.alias("outcome"), confidence.alias("confidence"),
        (F.col("j.result") == "partial").alias("partial"), took.alias("duration_ms"), F.col("j.count").alias("dropped"), F.col("j.buildId").alias("build_id"), F.col("j.state").alias("state"),
    )


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last record of each key, by a map-side maximum."""
    cols = [c for c in events.columns if c != key and c not in order]
    return events.groupBy(key).agg(F.max(F.struct(*order, *cols)).alias("v")).select(key, "v.*")


def retained(events: DataFrame, now: Column, keep: datetime.timedelta, most: int, most_bytes: int) -> DataFrame:
    """Records young enough, the newest first until `most` rows or `most_bytes` are reached."""
    young = events.where(F.col("ts") >= now - F.expr(f"interval {int(keep.total_seconds())} seconds"))
    # the cut needs only the newest rows, so a distributed top-k comes before the window over them
    top = young.orderBy(F.desc("ts"), "event_id").limit(most)
    w = Window.orderBy(F.desc("ts"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return top.withColumn("running", F.sum(F.octet_length("props")).over(w)).where(F.col("running") <= most_bytes)


def keyset_page(events: DataFrame, after: tuple[str, int] | None, size: int) -> DataFrame:
    """A page in order (ts desc, event_id asc) behind a cursor."""
    if after:
        ts = F.lit(after[0]).cast("timestamp_ntz")
        events = events.where((F.col("ts") < ts) | ((F.col("ts") == ts) & (F.col("event_id") > after[1])))
    return events.orderBy(F.desc("ts"), "event_id").limit(size)


def byte_budget(rows: DataFrame, order: list[str], text: str, most_bytes: int) -> DataFrame:
    """The leading rows whose texts fit into a byte budget."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(F.octet_length(text)).over(w)).where(F.col("running") <= most_bytes)


def phase_durations(runs: DataFrame) -> DataFrame:
    """Runs with the seconds until the next one of their key starts."""
    w = Window.partitionBy("key").orderBy("started_at")
    return runs.withColumn("seconds", F.unix_micros(F.lead("started_at").over(w)) / 1e6 - F.unix_micros("started_at") / 1e6)


def rate_and_eta(progress: DataFrame, least_files: int = 100, least_seconds: float = 1.0) -> DataFrame:
    """Files a second, and seconds left, once enough has been done to tell."""
    known = (F.col("files_done") >= least_files) & (F.col("elapsed_s") >= least_seconds)
    rate = F.when(known, F.col("files_done") / F.col("elapsed_s"))
    return progress.withColumn("rate", rate).withColumn("eta_s", (F.col("files_total") - F.col("files_done")) / F.col("rate"))


def operation_page(
    ops: DataFrame, size: int, after: tuple[str, str] | None = None, tools: tuple[str, ...] = (), outcomes: tuple[str, ...] = (), confidences: tuple[str, ...] = (), states: tuple[str, ...] = (), correlation: str | None = None,
    partial: bool | None = None, since: str | None = None, until: str | None = None, least_ms: float | None = None, most_ms: float | None = None,
) -> DataFrame:
    """A page of operations (newest first, then by correlation id) under any of ten filters, behind a cursor (time, correlation id)."""
    for column, some in (("tool", tools), ("outcome", outcomes), ("confidence", confidences), ("state", states)):
        if some:
            ops = ops.where(F.col(column).isin(*some))
    if correlation is not None:
        ops = ops.where(F.col("correlation_id") == correlation)
    if partial is not None:
        ops = ops.where(F.col("partial") == partial)
    if since is not None:
        ops = ops.where(F.col("emitted_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        ops = ops.where(F.col("emitted_at") < F.lit(until).cast("timestamp"))
    if least_ms is not None:
        ops = ops.where(F.col("duration_ms") >= least_ms)
    if most_ms is not None:
        ops = ops.where(F.col("duration_ms") <= most_ms)
    if after:
        at = F.lit(after[0]).cast("timestamp")
        ops = ops.where((F.col("emitted_at") < at) | ((F.col("emitted_at") == at) & (F.col("correlation_id") > after[1])))
    return ops.orderBy(F.desc("emitted_at"), "correlation_id").limit(size)

"""Event logs as streams: tailing JSON lines, windows, latest state; all with checkpoints, so a restart repeats nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeloom.operators.events import latest, normalise
from codeloom.operators.symbols import running_total
from codeloom.sources.tables import Scratch
from codeloom.sources.versions import VersionedTable

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: A line longer than this is not parsed; it is told as a truncated record, so that nothing is lost silently.
LONGEST_LINE = 256 * 1024


def tail(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Records of a folder of JSON-lines logs, new files as they come."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return normalise(lines.select(bounded_line(F.col("value")).alias("value")))


def bounded_line(line: Column) -> Column:
    """A line, or, if it is too long, a record that says so."""
    return F.when(F.octet_length(line) <= LONGEST_LINE, line).otherwise(F.lit(f'{{"e": "telemetry_truncated", "capBytes": {LONGEST_LINE}}}'))


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events of a table that is a folder of files or one file: a pattern is read where a plain path has to be a folder."""
    return spark.readStream.schema(EVENTS).parquet(f"{path[:-1]}?")


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) per tumbling window; the watermark bounds the state."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    w = F.window("at", width)
    return timed.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def drain(stream: DataFrame, scratch: Scratch, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there now and returns its result as a table."""
    target, checkpoint = f"{scratch.base}/drained", f"{scratch.base}/checkpoint"

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure overwrites its own output
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    got = stream.sparkSession.read.schema(stream.schema.add("batch", "long")).parquet(target)
    if mode == "complete":
        got = got.join(got.agg(F.max("batch").alias("last")), F.col("batch") == F.col("last")).drop("last")
    return got.drop("batch")


def keep_latest(stream: DataFrame, state: VersionedTable, key: str, order: list[str], checkpoint: str):
    """Upserts each micro-batch's last record per key into a versioned table; returns the running query.

    A batch that is repeated after a failure writes the same rows again, and
    readers only ever see whole versions.
    """

    def merge(batch: DataFrame, number: int) -> None:
        both = state.read().unionByName(batch.select(*state.read().columns))
        state.publish(state.stage(latest(both, key, order)))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def capped(records: DataFrame, order: list[Column], cap: int, scratch: Scratch) -> DataFrame:
    """A log's lines (value) in order as far as `cap` bytes hold them, and, if there are more, a record that says so in the end.

    The running number of bytes is a sum within sorted ranges and over the ranges'
    totals, so no task sees more than its range.
    """
    kept = running_total(records.withColumn("bytes", F.octet_length("value") + 1), order, "bytes", scratch)
    inside = kept.where(F.col("running") <= cap)
    told = kept.agg(F.max("running").alias("all")).where(F.col("all") > cap).select(F.lit(f'{{"e": "telemetry_truncated", "capBytes": {cap}}}').alias("value"))
    return inside.select("value").unionByName(told)


def expired(files: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Log files (path, modified) older than the retention."""
    return files.where(F.col("modified") < now - F.expr(f"interval {days} days"))

"""Queries over event records and run history, batch and streaming, and their SQL."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codeloom.operators import events as E
from codeloom.sources.tables import Scratch, table
from codeloom.streaming import telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _micros(c: Column) -> Column:
    """A time without zone as microseconds, in whatever zone the session is."""
    return F.unix_micros(F.concat(c.cast("timestamp_ntz").cast("string"), F.lit("Z")).cast("timestamp"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, max(ts) AS last_at, count_if(event_type = 'error') AS errors FROM events GROUP BY 1")
def a16_event_totals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,4)")), 4).cast("double").alias("total"), F.max("ts").alias("last_at"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS most FROM events GROUP BY 1")
def a18_percentiles(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.max("value").alias("most"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 5 AND count(DISTINCT event_type) >= 3")
def a19_busy_users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("k")).where("n >= 5 and k >= 3").select("user_id", "n")


@query("SELECT event_id, ts, user_id, (props->>'$.k')::BIGINT AS k, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'partial' ELSE 'success' END AS outcome FROM events")
def r6_normalised(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "partial").otherwise("success")
    return table(spark, d, "events").select("event_id", "ts", "user_id", F.from_json("props", "k long")["k"].alias("k"), outcome.alias("outcome"))


@query("SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def r7_latest_state(spark: SparkSession, d: str) -> DataFrame:
    return E.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"])


@query(
    """WITH y AS (SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY ORDER BY ts DESC, event_id LIMIT 512)
SELECT event_id, ts FROM (SELECT *, sum(strlen(props)) OVER (ORDER BY ts DESC, event_id ROWS UNBOUNDED PRECEDING) AS running FROM y) WHERE running <= 2000"""
)
def r8_retained(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    now = e.agg(F.max("ts")).first()[0]
    return E.retained(e, F.lit(str(now)).cast("timestamp_ntz"), datetime.timedelta(days=1), 512, 2000).select("event_id", "ts")


@query("SELECT DISTINCT user_id FROM events e WHERE event_type = 'signup' AND EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase')")
def r9_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.where("event_type = 'signup'").select("user_id").distinct().join(e.where("event_type = 'purchase'").select("user_id"), "user_id", "left_semi")


@query("SELECT event_id, ts, value FROM events WHERE event_type IN ('error', 'purchase') AND value >= 10 AND ts < TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts DESC, event_id LIMIT 40")
def r10_filtered_page(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where(F.col("event_type").isin("error", "purchase") & (F.col("value") >= 10))
    return E.keyset_page(e, ("2024-01-20 00:00:00", -1), 40).where("ts < timestamp_ntz'2024-01-20 00:00:00'").select("event_id", "ts", "value")


@query("SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-15 12:00:00' OR (ts = TIMESTAMP '2024-01-15 12:00:00' AND event_id > 100) ORDER BY ts DESC, event_id LIMIT 64")
def t13_keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return E.keyset_page(table(spark, d, "events"), ("2024-01-15 12:00:00", 100), 64).select("event_id", "ts")


@query("SELECT event_id FROM (SELECT event_id, sum(strlen(props)) OVER (ORDER BY ts DESC, event_id ROWS UNBOUNDED PRECEDING) AS running FROM events) WHERE running <= 4096")
def t14_byte_budget(spark: SparkSession, d: str) -> DataFrame:
    """The newest records that fit into 4 KiB. A record takes a byte at least, so no more rows than bytes can be in it: a distributed top-k comes before the running sum."""
    top = table(spark, d, "events").where(F.octet_length("props") > 0).orderBy(F.desc("ts"), "event_id").limit(4096)
    free = table(spark, d, "events").where(F.octet_length("props") == 0)
    kept = E.byte_budget(top, [F.desc("ts"), F.col("event_id")], "props", 4096)
    last = kept.agg(F.max(F.struct(-_micros(F.col("ts")), "event_id")).alias("last"))
    # records without bytes fit as long as those before them do
    inside = free.crossJoin(F.broadcast(last)).where(F.struct(-_micros(F.col("ts")), "event_id") <= F.col("last"))
    return kept.select("event_id").unionByName(inside.select("event_id"))


@query("SELECT run_id, attempt, round(epoch_us(lead(started_at) OVER (ORDER BY started_at, run_id, attempt)) / 1e6 - epoch_us(started_at) / 1e6, 3) AS seconds FROM index_runs")
def w7_run_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Seconds from each run to the next; the table of runs does not grow, so one window holds it."""
    r = table(spark, d, "index_runs").select("run_id", "attempt", "started_at")
    w = Window.orderBy("started_at", "run_id", "attempt")
    micros = _micros
    return r.select("run_id", "attempt", F.round(micros(F.lead("started_at").over(w)) / 1e6 - micros(F.col("started_at")) / 1e6, 3).alias("seconds"))


@query(
    """WITH n AS (SELECT run_id, attempt, count(DISTINCT path) AS done FROM file_checkpoints GROUP BY ALL), t AS (SELECT count(*) AS total FROM files),
 x AS (SELECT r.run_id, r.attempt, coalesce(done, 0) AS files_done, (epoch_us(finished_at) - epoch_us(started_at)) / 1e6 AS elapsed_s, total FROM index_runs r LEFT JOIN n USING (run_id, attempt), t)
SELECT run_id, attempt, round(CASE WHEN files_done >= 100 AND elapsed_s >= 1 THEN files_done / elapsed_s END, 6) AS rate, round((total - files_done) / (CASE WHEN files_done >= 100 AND elapsed_s >= 1 THEN files_done / elapsed_s END), 3) AS eta_s FROM x"""
)
def a17_rates(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "file_checkpoints").groupBy("run_id", "attempt").agg(F.count_distinct("path").alias("done"))
    r = table(spark, d, "index_runs").join(n, ["run_id", "attempt"], "left")
    total = table(spark, d, "files").agg(F.count("*").alias("files_total"))
    micros = lambda c: _micros(F.col(c))
    p = r.crossJoin(F.broadcast(total)).select("run_id", "attempt", F.coalesce("done", F.lit(0)).alias("files_done"), "files_total", ((micros("finished_at") - micros("started_at")) / 1e6).alias("elapsed_s"))
    return E.rate_and_eta(p, 100, 1.0).select("run_id", "attempt", F.round("rate", 6).alias("rate"), F.round("eta_s", 3).alias("eta_s"))


@query(
    """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM g) SELECT user_id, burst::BIGINT AS burst, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM b GROUP BY 1, 2"""
)
def r3_coalesced_bursts(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user that follow within six hours are one burst."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w)
    e = table(spark, d, "events").withColumn("fresh", F.when(gap.isNull() | (gap > F.expr("interval 6 hours")), 1).otherwise(0))
    e = e.withColumn("burst", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "burst").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def r12_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling hours as a stream over the whole table, drained once."""
    scratch = Scratch(spark, "windows")
    got = telemetry.drain(telemetry.window_counts(telemetry.event_stream(spark, f"{d}/events.parquet")), scratch)
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))

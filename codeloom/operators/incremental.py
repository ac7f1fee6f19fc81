"""Processing only new or changed records against a persisted, versioned state.

State is a table of what the successful runs knew of each key, kept under one
fixed folder from run to run, and beside it a ledger of the run attempts that it
holds. A run first brings the state up to the history: of attempts that the
ledger has, nothing is read again; those that are new, or whose rows are more
than they were, are merged in by the greatest (run, attempt), which may be done
any number of times with one result. Only if the history contradicts the ledger
(an attempt is gone or has changed) is the state drawn from the whole history again;
what runs committed themselves is kept even then.

Then the current rows are joined with the state. Only after a run's work has
succeeded does `commit_run` publish the next version: files first, then one
atomic rename. A run that fails in between leaves the old version current, so
the next run sees the same changes again: nothing is skipped, and nothing that
was committed comes again. Two runs that started from one version cannot both
commit; the later one hears of it.

Defined results: rows of one key count once (of different rows with one key the
greatest wins); a null key never matches, so it is always new; where either hash
is null the times are compared, null-safe; keys that are gone leave a mark at the
next commit, so that they are new when they return; extra columns are ignored; an
empty state makes every row new, an empty input gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeloom.sources.tables import shared_dir
from codeloom.sources.versions import Conflict, Versions

_LAST = ("run_id", "attempt", "recorded_at", "checkpoint_id", "gone", "own", "hash", "mtime")
STATE_SCHEMA = "key string, run_id long, attempt int, recorded_at timestamp, checkpoint_id long, gone boolean, own boolean, hash long, mtime long"
LEDGER_SCHEMA = "run_id long, attempt int, rows long, low long, high long"


class StateStore(Versions):
    """Versions of the state and its ledger under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, {"state": STATE_SCHEMA, "ledger": LEDGER_SCHEMA})

    def read(self) -> DataFrame:
        return self.read_part("state")


def store_of(spark: SparkSession, name: str) -> StateStore:
    """The one store of a named source, in the folder that all runs share."""
    return StateStore(spark, f"{shared_dir(spark)}/incremental-state/{hashlib.sha256(name.encode()).hexdigest()[:24]}")


def _latest(rows: DataFrame) -> DataFrame:
    """Of each key its row of the highest (run, attempt); taken map-side first, so one key with very many rows is no hot spot. Rows of one attempt that differ: the latest recorded wins."""
    return rows.groupBy("key").agg(F.max(F.struct(*_LAST)).alias("v")).select("key", "v.*")


def _ok(runs: DataFrame) -> DataFrame:
    return runs.where("status = 'ok' and run_id is not null and attempt is not null").select("run_id", F.col("attempt").cast("int").alias("attempt")).distinct()


def _history(runs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """What attempts that ended 'ok' wrote down."""
    c = checkpoints.where("path is not null").select(
        F.col("path").alias("key"), "run_id", F.col("attempt").cast("int").alias("attempt"), "recorded_at", "checkpoint_id", F.lit(False).alias("gone"), F.lit(False).alias("own"), "hash", F.col("mtime_ticks").alias("mtime")
    )
    return c.join(_ok(runs), ["run_id", "attempt"], "left_semi")


def known_state(runs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """State from history: of each path its checkpoint with the highest (run, attempt) among attempts that ended 'ok'."""
    return _latest(_history(runs, checkpoints))


def _ledger(history: DataFrame) -> DataFrame:
    """What stands for each attempt's rows: their number and the sums of the halves of their hashes, the same in any order."""
    h = F.xxhash64("key", "recorded_at", "checkpoint_id", "hash", "mtime")
    return history.groupBy("run_id", "attempt").agg(F.count("*").alias("rows"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftright(h, 32)).alias("high"))


def catch_up(store: StateStore, runs: DataFrame, checkpoints: DataFrame) -> int:
    """Brings the state up to the history and publishes that if anything is new; the version then current."""
    history = _history(runs, checkpoints)
    now = _ledger(history)
    if not store.version():
        try:
            return store.publish(store.stage_parts({"state": _latest(history), "ledger": now}))
        except Conflict:
            return catch_up(store, runs, checkpoints)
    kept = store.read_part("ledger")
    old = kept.select(*[F.col(c).alias(f"k_{c}") for c in kept.columns])
    both = now.join(old, (now["run_id"] == old["k_run_id"]) & (now["attempt"] == old["k_attempt"]), "full")
    known = F.col("k_run_id").isNotNull()
    same = (F.col("rows") == F.col("k_rows")) & (F.col("low") == F.col("k_low")) & (F.col("high") == F.col("k_high"))
    # rows that came late to a known attempt are merged; fewer or other rows contradict what the state was drawn from
    act = F.when(~known, "merge").when(F.col("run_id").isNull(), "again").when(same, "none").when(F.col("rows") > F.col("k_rows"), "merge").otherwise("again")
    # one row an attempt: bounded by the number of runs
    plan = both.select(F.coalesce("run_id", "k_run_id").alias("run_id"), F.coalesce("attempt", "k_attempt").alias("attempt"), act.alias("act")).where("act <> 'none'")
    acts = {r["act"] for r in plan.select("act").distinct().collect()}
    if not acts:
        return store.version()
    if "again" in acts:
        state = _latest(history.unionByName(store.read().where("own")))
    else:
        fresh = history.join(plan.select("run_id", "attempt"), ["run_id", "attempt"], "left_semi")
        state = _latest(store.read().unionByName(fresh))
    try:
        return store.publish(store.stage_parts({"state": state, "ledger": now}))
    except Conflict:
        return catch_up(store, runs, checkpoints)


def current_rows(files: DataFrame) -> DataFrame:
    """(file_id, key, hash, mtime): one row a file id."""
    return files.groupBy(F.col("id").alias("file_id")).agg(F.max(F.struct("path", "hash", "mtime_ticks")).alias("v")).select("file_id", F.col("v.path").alias("key"), F.col("v.hash").alias("hash"), F.col("v.mtime_ticks").alias("mtime"))


def changes(current: DataFrame, state: DataFrame) -> DataFrame:
    """(file_id, change): 'new' or 'changed' rows of `current` against `state`."""
    s = state.where("not gone").select(F.col("key").alias("s_key"), F.col("hash").alias("s_hash"), F.col("mtime").alias("s_mtime"))
    same = F.when(F.col("hash").isNull() | F.col("s_hash").isNull(), F.col("mtime").eqNullSafe(F.col("s_mtime"))).otherwise(F.col("hash") == F.col("s_hash"))
    change = F.when(F.col("s_key").isNull(), "new").when(~same, "changed")
    # Null keys match nothing; kept out of the join they cannot pile up in one partition.
    lone = current.where("key is null").select("file_id", F.lit("new").alias("change"))
    keyed = current.where("key is not null")
    return keyed.join(s, keyed["key"] == s["s_key"], "left").select("file_id", change.alias("change")).where("change is not null").unionByName(lone)


def next_run(spark: SparkSession, files: DataFrame, runs: DataFrame, checkpoints: DataFrame, store: StateStore | str) -> DataFrame:
    """What the next run has to process, by the store's state; nothing counts as processed before `commit_run`."""
    store = store_of(spark, store) if isinstance(store, str) else store
    catch_up(store, runs, checkpoints)
    return changes(current_rows(files), store.read())


def _time(c: Column) -> Column:
    return c.cast("timestamp")


def commit_run(store: StateStore, current: DataFrame, processed: DataFrame, run_id: int, attempt: int = 1, base: int | None = None) -> int:
    """After a run has ended well: the processed rows become known as of (run_id, attempt), keys that `current` no longer has are marked gone; the new version.

    `base` is the version that the run started from: if another run has committed
    since, nothing is published and `Conflict` is raised.
    """
    if base is not None and base != store.version():
        raise Conflict(f"version {base} is not current any more")
    stamp = [F.lit(run_id).cast("long").alias("run_id"), F.lit(attempt).cast("int").alias("attempt"), _time(F.lit(None)).alias("recorded_at"), F.lit(None).cast("long").alias("checkpoint_id")]
    keyed = current.where("key is not null")
    done = keyed.join(processed.select("file_id").distinct(), "file_id", "left_semi").select("key", *stamp, F.lit(False).alias("gone"), F.lit(True).alias("own"), "hash", "mtime")
    old = store.read()
    left = old.where("not gone").join(keyed.select("key").distinct(), "key", "left_anti").select("key", *stamp, F.lit(True).alias("gone"), F.lit(True).alias("own"), "hash", "mtime")
    return store.publish(store.stage_parts({"state": _latest(old.unionByName(done).unionByName(left))}))

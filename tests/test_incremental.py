import pytest

from codeloom.operators.incremental import StateStore, catch_up, changes, commit_run, current_rows, known_state, next_run
from codeloom.sources.versions import Conflict

FILES = "id long, path string, hash long, mtime_ticks long, key string"
RUNS = "run_id long, attempt int, status string"
CHECK = "checkpoint_id long, run_id long, attempt int, path string, mtime_ticks long, hash long, recorded_at timestamp"


def files(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], FILES)


def got(df):
    return {tuple(r) for r in df.collect()}


def test_next_run(spark, tmp_path):
    runs = spark.createDataFrame([(1, 1, "ok"), (2, 1, "failed"), (2, 2, "ok"), (3, 1, None), (1, 1, "ok")], RUNS)
    check = [
        (1, 1, 1, "a", 5, 10, None), (1, 1, 1, "a", 5, 10, None), (2, 2, 1, "a", 6, 99, None),  # failed attempt
        (3, 1, 1, "b", 5, 10, None), (4, 2, 2, "b", 5, 11, None),
        (5, 1, 1, "c", 7, None, None), (6, 1, 1, "d", 7, None, None), (7, 3, 1, "e", 1, 1, None), (8, 1, 1, None, 1, 1, None), (9, 1, 1, "gone", 1, 1, None),
    ]
    f = files(spark, [(1, "a", 10, 50), (2, "b", 10, 5), (3, "c", 3, 7), (4, "d", 3, 8), (5, "e", 1, 1), (6, "f", None, None), (7, None, 1, 1), (1, "a", 10, 50)])
    store = StateStore(spark, f"file://{tmp_path}/s")
    want = {(2, "changed"), (4, "changed"), (5, "new"), (6, "new"), (7, "new")}
    c = spark.createDataFrame(check, CHECK)
    assert got(next_run(spark, f, runs, c, store)) == want
    assert got(next_run(spark, f, runs, c, store)) == want and store.version() == 1  # nothing new: the state is only read
    # a new attempt is merged; rows that come late to a known attempt are, too
    runs = runs.unionByName(spark.createDataFrame([(4, 1, "ok")], RUNS))
    c = c.unionByName(spark.createDataFrame([(10, 4, 1, "e", 1, 1, None), (11, 2, 2, "d", 8, 3, None)], CHECK))
    assert got(next_run(spark, f, runs, c, store)) == {(2, "changed"), (6, "new"), (7, "new")} and store.version() == 2
    # a history that contradicts what was read is read whole
    less = c.where("run_id <> 2")
    assert got(next_run(spark, f, runs, less, store)) == {(4, "changed"), (6, "new"), (7, "new")} and store.version() == 3


def test_a_crash_repeats_and_a_commit_ends(spark, tmp_path):
    """Run, crash before the commit, run, commit, run: all, all, none, also through a store opened anew."""
    at = f"file://{tmp_path}/s"
    runs, check = spark.createDataFrame([(1, 1, "ok")], RUNS), spark.createDataFrame([(1, 1, 1, "a", 1, 1, None)], CHECK)
    f = files(spark, [(1, "a", 2, 1), (2, "b", 1, 1), (3, "c", 1, 1)])
    every = {(1, "changed"), (2, "new"), (3, "new")}
    run = lambda rows=f: next_run(spark, rows, runs, check, StateStore(spark, at))
    assert got(run()) == every
    StateStore(spark, at).stage_parts({"state": StateStore(spark, at).read()})  # a crash after staging
    todo = run()
    assert got(todo) == every
    base = StateStore(spark, at).version()
    commit_run(StateStore(spark, at), current_rows(f), todo.where("file_id < 3"), run_id=2, base=base)
    assert got(run()) == {(3, "new")}
    with pytest.raises(Conflict):
        commit_run(StateStore(spark, at), current_rows(f), todo, run_id=2, base=base)
    commit_run(StateStore(spark, at), current_rows(f), run(), run_id=3)
    assert got(run()) == set()
    # gone, committed, and back: new
    less = f.where("id <> 2")
    assert got(run(less)) == set()
    commit_run(StateStore(spark, at), current_rows(less), run(less), run_id=4)
    assert got(run()) == {(2, "new")}
    # what runs committed outlives a history drawn anew
    assert got(next_run(spark, f, runs.limit(0), check.limit(0), StateStore(spark, at))) == {(2, "new")}


def test_two_writers(spark, tmp_path):
    store = StateStore(spark, f"file://{tmp_path}/s")
    catch_up(store, spark.createDataFrame([], RUNS), spark.createDataFrame([], CHECK))
    one, two = store.stage_parts({}), store.stage_parts({})
    store.publish(one)
    with pytest.raises(Conflict):
        store.publish(two)
    with pytest.raises(ValueError):
        store.publish((3, "v=3-none"))


def test_empty(spark, tmp_path):
    store = StateStore(spark, f"file://{tmp_path}/s")
    none = spark.createDataFrame([], FILES)
    assert next_run(spark, none, spark.createDataFrame([], RUNS), spark.createDataFrame([], CHECK), store).count() == 0
    assert known_state(spark.createDataFrame([], RUNS), spark.createDataFrame([], CHECK)).count() == 0
    assert got(changes(current_rows(files(spark, [(1, "a", 1, 1)])), store.read())) == {(1, "new")}

"""The ledger, incremental runs, the work list and redelivered messages."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lodestone.operators import incremental as inc
from lodestone.operators import redelivery as red
from lodestone.session import new_path
from lodestone.sources.ledger import CommitConflict, Ledger
from lodestone.sources.tables import arriving


def _ts(df, *columns):
    return df.withColumns({c: F.timestamp_seconds(c).cast("timestamp_ntz") for c in columns})


def test_commits_are_atomic_and_ordered(spark):
    ledger = Ledger(spark, new_path(spark, "t"))
    assert ledger.latest() is None and ledger.read() is None
    data = ledger.stage(spark.range(3).toDF("x"))
    assert ledger.read() is None  # staged is not visible
    first = ledger.commit(None, {"sequence": 3}, data)
    with pytest.raises(CommitConflict):
        ledger.commit(None, {"sequence": 9}, data)
    ledger.commit(first, {"sequence": 5}, ledger.stage(spark.range(3, 5).toDF("x")))
    assert sorted(r.x for r in ledger.read().collect()) == [0, 1, 2, 3, 4] and ledger.latest().watermark == {"sequence": 5}


def test_runs_skip_and_repeat_nothing(spark):
    ledger = Ledger(spark, new_path(spark, "t"))
    rows = [(i,) for i in range(1, 11)]
    source = spark.createDataFrame(rows, "seq int")
    run = inc.IncrementalRun(ledger, source, "seq")

    def dies(df):
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        run.finish(dies)
    run = inc.IncrementalRun(ledger, source, "seq")
    assert (run.window.last, run.window.upper, run.rows.count()) == ({}, "10", 10)
    run.finish(lambda df: df)
    more = spark.createDataFrame(rows + [(11,), (12,)], "seq int")
    late = inc.IncrementalRun(ledger, more, "seq")
    assert sorted(r.seq for r in late.rows.collect()) == [11, 12]
    rival = inc.IncrementalRun(ledger, more, "seq")
    late.finish(lambda df: df)
    with pytest.raises(CommitConflict):
        rival.finish(lambda df: df)
    again = inc.IncrementalRun(ledger, more, "seq")
    assert again.rows.count() == 0 and again.finish(lambda df: df).version == 2
    assert sorted(r.seq for r in ledger.read().collect()) == list(range(1, 13))
    empty = inc.IncrementalRun(Ledger(spark, new_path(spark, "t")), source.limit(0), "seq")
    assert empty.rows.count() == 0 and empty.finish(lambda df: df).data is None


def _tables(spark):
    chunks = _ts(spark.createDataFrame([("a", "r", "h1", True, 1), ("a", "r", "h1", False, 5), ("b", "r", "h2", True, 1), ("c", "r", None, None, 1), ("d", "r", "h4", True, 1), (None, "r", "h", True, 1), ("e", "r", "h5", True, 2), ("e", "r", "h5", True, 2)], "chunk_id string, repository string, content_hash string, active boolean, created_at int"), "created_at")
    runs = _ts(spark.createDataFrame([(1, "r", "p", "q", "completed", 10, 20, 20), (1, "r", "p", "q", "in_progress", 10, None, 12), (2, "r", "q", "s", "failed", 30, 40, 40), (3, "r", None, "z", "completed", 50, 60, 60), (4, "r", "q", "s", "completed", 70, None, 70), (4, "r", "q", "s", "in_progress", 70, None, 70)], "run_no long, repository string, previous_commit string, current_commit string, status string, started_at int, finished_at int, updated_at int"), "started_at", "finished_at", "updated_at")
    indexed = spark.createDataFrame([(1, "a", "h1", True, "x"), (1, "b", "h2", True, "x"), (2, "b", "h9", True, "x"), (3, "c", None, None, "x"), (1, "e", "h0", True, "x"), (3, "e", "h5", True, "x"), (3, "e", "h5", True, "x"), (None, "d", "h4", True, "x")], "run_no long, chunk_id string, content_hash string, active boolean, status string")
    changes = _ts(spark.createDataFrame([(1, "r", "p", "q", 5), (2, "r", "p", "q", 15), (2, "r", "p", "q", 8), (3, "r", "p", "q", 11), (4, "r", "q", "s", 69), (5, "r", "q", "s", 71), (6, "r", None, "z", 1), (None, "r", "p", "q", 1)], "change_no long, repository string, previous_commit string, current_commit string, recorded_at int"), "recorded_at")
    return chunks, changes, runs, indexed


NAMES = ["chunks", "code_changes", "index_runs", "indexed_chunks"]


def _list(ledger, tables, limits=None):
    commit = inc.next_work_list(ledger, dict(zip(NAMES, tables)), limits)
    rows = [tuple(r) for r in ledger.part(commit, "work").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def _new(spark):
    return Ledger(spark, new_path(spark, "t"))


def test_work_list(spark):
    chunks, changes, runs, indexed = tables = _tables(spark)
    got = _list(_new(spark), tables)
    assert got == {("chunk", "a"), ("chunk", "d"), ("change", "3"), ("change", "5"), ("change", "6")}
    assert len(_list(_new(spark), (chunks, changes, runs.limit(0), indexed.limit(0)))) == 5 + 6
    assert _list(_new(spark), [t.limit(0) for t in tables]) == set()


def test_limits_hold_rows_back_until_the_next_run(spark):
    tables, ledger = _tables(spark), _new(spark)
    early = _list(ledger, tables, {"index_runs": "1970-01-01 00:01:00", "chunks": "1970-01-01 00:00:01"})
    assert ("change", "4") in early and ("chunk", "a") not in early
    assert _list(ledger, tables) == _list(_new(spark), tables) and ledger.latest().version == 2


def test_any_cut_gives_the_same_list(spark):
    """Runs up to any point and then to the end find what one run over everything finds, completed runs that fail later included."""
    chunks, changes, runs, indexed = _tables(spark)
    more = _ts(spark.createDataFrame([(1, "r", "p", "q", "failed", 10, 20, 90), (2, "r", "q", "s", "completed", 30, 40, 95)], "run_no long, repository string, previous_commit string, current_commit string, status string, started_at int, finished_at int, updated_at int"), "started_at", "finished_at", "updated_at")
    tables = (chunks, changes, runs.unionByName(more), indexed)
    whole = _list(_new(spark), tables)
    assert ("chunk", "b") in whole  # run 1 failed in the end, run 2 took other content
    for second in (15, 45, 65, 92):
        ledger = _new(spark)
        _list(ledger, tables, {"index_runs": f"1970-01-01 00:{second // 60:02d}:{second % 60:02d}", "chunks": "1970-01-01 00:00:01", "code_changes": "1970-01-01 00:00:11", "indexed_chunks": 1})
        assert _list(ledger, tables) == whole


def _save(df, folder, name):
    df.write.mode("append").parquet(f"{folder}/{name}.parquet")


def _arriving(spark, folder):
    return [arriving(spark, folder, n) for n in NAMES]


def test_late_rows_reruns_and_lost_runs(spark, tmp_path):
    folder, ledger = f"file://{tmp_path}", _new(spark)
    tables = _tables(spark)
    for name, df in zip(NAMES, tables):
        _save(df, folder, name)
    first = _list(ledger, _arriving(spark, folder))
    # Without new rows nothing is read, and the commit stays the last.
    window = inc.windows({n: (df, inc.SEQUENCES[n]) for n, df in zip(NAMES, _arriving(spark, folder))}, ledger.latest().watermark)
    assert all(w.is_empty and w.rows.count() == 0 for w in window.values())
    before = ledger.latest()
    assert inc.next_work_list(ledger, dict(zip(NAMES, _arriving(spark, folder)))) == before
    # Late rows: all of their sequences are below the watermarks.
    time.sleep(1.1)
    _save(_ts(spark.createDataFrame([("late", "r", "h", True, 1)], "chunk_id string, repository string, content_hash string, active boolean, created_at int"), "created_at"), folder, "chunks")
    _save(_ts(spark.createDataFrame([(77, "r", "p", "q", 9), (3, "r", "p", "q", 2)], "change_no long, repository string, previous_commit string, current_commit string, recorded_at int"), "recorded_at"), folder, "code_changes")
    tables = _arriving(spark, folder)
    # A run that dies between writing and committing leaves no trace, and the next one takes the same rows, once.
    commit = ledger.commit
    ledger.commit = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("driver lost"))
    with pytest.raises(RuntimeError):
        inc.next_work_list(ledger, dict(zip(NAMES, tables)))
    ledger.commit = commit
    assert ledger.latest() == before
    fresh = inc.windows({n: (df, inc.SEQUENCES[n]) for n, df in zip(NAMES, tables)}, before.watermark)
    assert [fresh[n].rows.count() for n in NAMES] == [1, 2, 0, 0]
    got = _list(ledger, tables)
    assert got == first - {("change", "3")} | {("chunk", "late")} == _list(_new(spark), tables)


def _ids(spark, rows):
    df = spark.createDataFrame(rows, "kind string, key array<string>, received_at int, no long, item int")
    return _ts(df, "received_at")


def _expected(rows):
    first = {}
    for kind, key, at, no, item in rows:
        if None not in key:
            k = kind, tuple(key)
            first[k] = min(first.get(k, (1e18,)), (1e17 if at is None else at, no, item))
    return {(kind, no, item) for kind, key, at, no, item in rows if None not in key and (1e17 if at is None else at, no, item) != first[kind, tuple(key)]}


def test_copies_over_many_buckets(spark):
    rng = random.Random(2)
    rows = [("m", [rng.choice("abcdefgh"), str(rng.randrange(400))], rng.choice([None, *range(0, 100 * 86400, 3600)]), i, rng.randrange(3)) for i in range(3000)]
    rows += [("m", ["hot", "1"], rng.randrange(0, 100 * 86400), 10_000 + i, 0) for i in range(1500)]
    rows += [("n", ["hot", "1"], 5, 1, 0), ("m", [None, "x"], 1, 20_000, 0), ("m", [None, "x"], 2, 20_001, 0)]
    got = [tuple(r) for r in red.repeats(_ids(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == _expected(rows)


def test_copies_small_tables(spark):
    assert red.repeats(_ids(spark, [("m", ["a"], 1, 1, 0)]).limit(0)).collect() == []
    rows = [("m", ["a"], 5, 2, 0), ("m", ["a"], 5, 1, 0), ("m", ["a"], 5, 1, 1)]
    assert {tuple(r) for r in red.repeats(_ids(spark, rows)).collect()} == {("m", 2, 0), ("m", 1, 1)}


def test_keys_without_case_and_blanks(spark):
    df = spark.createDataFrame([(" A\t",), ("a",), (None,)], "x string").select(red.same_key(F.col("x")).alias("k"))
    assert [r.k for r in df.collect()] == ["a", "a", None]

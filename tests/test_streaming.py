import json

from pyspark.sql import functions as F

from lodestone.session import new_path
from lodestone.sources.ledger import Ledger
from lodestone.streaming import events as ev


def _events(spark, rows):
    return spark.createDataFrame(rows, "ts int, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds("ts"))


def test_windows_with_late_rows(spark):
    folder, out, state = (new_path(spark, x) for x in "abc")
    _events(spark, [(10, 1, "a", 1.0), (20, 1, "a", 2.0), (50_000, 2, "b", 1.0)]).write.parquet(folder)
    schema = spark.read.parquet(folder).schema
    ev.start(ev.windowed_events(ev.read_events(spark, folder, schema)), out, state).awaitTermination()
    _events(spark, [(30, 1, "a", 9.0), (90_000, 3, "c", 1.0)]).write.mode("append").parquet(folder)
    ev.start(ev.windowed_events(ev.read_events(spark, folder, schema)), out, state).awaitTermination()
    got = {(r.event_type, r.n, r.total) for r in spark.read.parquet(out).collect()}
    assert ("a", 2, 3.0) in got and all(n < 3 for _, n, _ in got)


def test_sessions_as_table(spark):
    rows = [(0, 1, "a", 1.0), (1000, 1, "a", 1.0), (5000, 1, "a", 1.0), (0, 2, "a", 1.0)]
    got = sorted((r.user_id, r.n) for r in ev.session_windows(_events(spark, rows), "30 minutes").collect())
    assert got == [(1, 1), (1, 2), (2, 1)]


def test_payloads(spark):
    good = {"ref": "refs/heads/main", "before": "a", "after": "b", "repository": {"full_name": "o/r"}, "commits": []}
    df = spark.createDataFrame([(json.dumps(good),), ("{not json",), (json.dumps({"ref": "x"}),), (None,)], "value string")
    payloads, rejected = ev.parsed_payloads(df)
    assert [r.after for r in payloads.collect()] == ["b"] and rejected.count() == 3


def test_fold_is_idempotent(spark):
    fold = ev.WorkflowFold(Ledger(spark, new_path(spark, "w")))
    df = spark.createDataFrame([("w", "pending", "queued", 0, "t1", 1), ("w", "done", "done", 100, "t3", 3), (None, "x", "x", 1, "t", 4)], "workflow_id string, status string, rag_stage string, rag_progress int, state_time string, state_no long")
    fold(df, 0)
    fold(df.where("state_no = 1"), 0)
    fold(spark.createDataFrame([("w", "pending", "queued", 5, "t2", 2), ("v", "pending", "queued", 5, "t2", 5)], df.schema), 1)
    from lodestone.operators.snapshots import current

    assert {r.workflow_id: r.status for r in current(fold.ledger).collect()} == {"w": "done", "v": "pending"}
    assert fold.ledger.latest().version == 2


def test_progress():
    assert [ev.progress("chunking", 0, 9), ev.progress("chunking", 9, 9), ev.progress("embedding", 1, 2), ev.progress("embedding", 0, 0)] == [5, 65, 75, 85]

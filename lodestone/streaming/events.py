"""Structured Streaming over the same operators: event windows with late data, payload ingestion, redelivery, workflow state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.events import session_windows, tumbling_windows

_COMMIT = "struct<id: string, message: string, timestamp: string, added: array<string>, modified: array<string>, removed: array<string>>"
#: The columns of a push payload as it is sent.
PAYLOAD = (
    "ref string, before string, after string, repository struct<id: bigint, name: string, full_name: string, clone_url: string, default_branch: string, owner: struct<name: string, email: string>>, "
    f"pusher struct<name: string, email: string>, commits array<{_COMMIT}>, head_commit {_COMMIT}"
)


def read_events(spark: SparkSession, folder: str, schema, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_events(events: DataFrame, length: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Append-mode tumbling windows; rows later than `lateness` are left out by the watermark."""
    return tumbling_windows(events.withWatermark("ts", lateness), length)


def user_sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "2 hours") -> DataFrame:
    return session_windows(events.withWatermark("ts", lateness), gap)


def parsed_payloads(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(payloads, rejected) of JSON texts: rejected are those that don't parse or lack a ref, a commit after it or a repository's name."""
    parsed = lines.withColumn("p", F.from_json(column, PAYLOAD + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    good = F.coalesce(F.col("p._corrupt").isNull() & F.col("p.ref").isNotNull() & F.col("p.after").isNotNull() & F.col("p.repository.full_name").isNotNull(), F.lit(False))
    return parsed.where(good).select("p.*").drop("_corrupt"), parsed.where(~good).select(column)


def first_deliveries(pushes: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each push once among those of `lateness`; what comes later than that again is for operators.redelivery to find in storage."""
    key = lambda c: F.lower(F.trim(c))
    keyed = pushes.withColumns({"_repository": key("repository.full_name"), "_ref": key("ref_name"), "_before": key("before_sha"), "_after": key("after_sha")})
    return keyed.withWatermark("received_at", lateness).dropDuplicatesWithinWatermark(["_repository", "_ref", "_before", "_after"]).drop("_repository", "_ref", "_before", "_after")


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    """Writes a stream as Parquet; with `once`, what is there now and then stops."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(availableNow=True) if once else writer).start()


def progress(stage: str, done: int, total: int) -> int:
    """Percent of a whole indexing run: splitting is 5 to 65, embedding 65 to 85."""
    part = done / total if total else 1.0
    return {"chunking": int(part * 60) + 5, "embedding": int(part * 20) + 65}.get(stage, 0)


class WorkflowFold:
    """foreachBatch body that keeps the latest state of each workflow in a table of versions.

    A batch is reduced to one row for each workflow before it meets the table; the batch's number is committed with the new
    version, so a batch that is delivered again after a failure changes nothing.
    """

    def __init__(self, ledger):
        self.ledger = ledger

    def __call__(self, batch: DataFrame, number: int) -> None:
        after = self.ledger.latest()
        if after and after.watermark["batch"] >= number:
            return
        columns = ["workflow_id", "status", "rag_stage", "rag_progress", "state_time", "state_no"]
        rows = batch.where("workflow_id is not null").select(columns)
        if after:
            rows = rows.unionByName(batch.sparkSession.read.schema(rows.schema).parquet(after.data))
        last = F.max_by(F.struct(*columns[1:]), F.struct("state_time", "state_no"))
        table = rows.groupBy("workflow_id").agg(last.alias("x")).select("workflow_id", "x.*")
        self.ledger.commit(after, {"batch": number}, self.ledger.stage(table))

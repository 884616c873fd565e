"""Queries on records that arrive again or changed, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators.incremental import SEQUENCES, limits_at, next_work_list
from lodestone.operators.redelivery import delivery_repeats
from lodestone.session import new_path
from lodestone.sources.ledger import Ledger
from lodestone.sources.tables import arriving, table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The work list after two runs: one up to nine tenths of each table's sequence, one from its watermark to the end.

    The ledger is new for each call, so that a call always processes the whole tables; a service keeps one ledger and calls `next_work_list`.
    """
    ledger = Ledger(spark, new_path(spark, "work"))
    tables = {n: arriving(spark, d, n) for n in SEQUENCES}
    next_work_list(ledger, tables, limits_at(tables, 0.9))
    return ledger.part(next_work_list(ledger, tables), "work")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return delivery_repeats(table(spark, d, "push_payloads"), table(spark, d, "workflow_states"))


QUERIES = {"p3_found": p3_found, "p4_found": p4_found}

_KEY = r"lower(regexp_replace({0}, '^\s+|\s+$', '', 'g'))"


def _drop(kind: str, source: str, key: list[str], no: str, item: str) -> str:
    keys = ", ".join(_KEY.format(k) for k in key)
    some = " AND ".join(f"{k} IS NOT NULL" for k in key)
    return f"""SELECT '{kind}' AS record_kind, record_no, item_no FROM (
        SELECT {no} AS record_no, CAST({item} AS INTEGER) AS item_no,
               row_number() OVER (PARTITION BY {keys} ORDER BY received_at NULLS LAST, {no}, {item}) AS n
        FROM {source} WHERE {some}) WHERE n > 1"""


SQL = {
    "p3_found": """
        WITH runs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_no ORDER BY updated_at DESC) AS n FROM index_runs) WHERE n = 1 AND status = 'completed'),
        last AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY chunk_id ORDER BY run_no DESC) AS n FROM indexed_chunks c WHERE run_no IN (SELECT run_no FROM runs)) WHERE n = 1),
        now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC) AS n FROM chunks) WHERE n = 1),
        arrived AS (SELECT change_no, repository, previous_commit, current_commit, min(recorded_at) AS at FROM code_changes GROUP BY ALL)
        SELECT 'chunk' AS record_kind, now.chunk_id AS record_key FROM now LEFT JOIN last ON now.chunk_id = last.chunk_id
        WHERE last.chunk_id IS NULL OR last.content_hash IS DISTINCT FROM now.content_hash OR last.active IS DISTINCT FROM now.active
        UNION ALL
        SELECT 'change', CAST(change_no AS VARCHAR) FROM arrived a WHERE NOT EXISTS (
            SELECT 1 FROM runs r WHERE r.repository = a.repository AND r.previous_commit = a.previous_commit AND r.current_commit = a.current_commit AND r.started_at >= a.at)""",
    "p4_found": " UNION ALL ".join(
        [
            _drop("push", "push_payloads", ["repository.full_name", "ref_name", "before_sha", "after_sha"], "delivery_no", "0"),
            _drop("commit", "(SELECT delivery_no, received_at, repository.full_name AS name, unnest(commits).id AS id, generate_subscripts(commits, 1) AS pos FROM push_payloads)", ["name", "id"], "delivery_no", "pos"),
            _drop("workflow", "workflow_states", ["repository", "branch", "commit_sha", "status", "rag_stage"], "state_no", "0"),
        ]
    ),
}

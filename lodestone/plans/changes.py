"""Queries on changes, pushes, index states, run logs and events, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.functions.files import DOC_EXTENSIONS
from lodestone.operators import changes as ch
from lodestone.operators import quality, snapshots
from lodestone.operators.chunks import newest
from lodestone.operators.events import session_windows, sliding_windows, tumbling_windows, workflow_state
from lodestone.operators.incremental import final_runs
from lodestone.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_FIRST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY change_no ORDER BY recorded_at, file_path) AS arrival FROM code_changes) WHERE arrival = 1)"
_SYMBOLS = ("added_symbols", "modified_symbols", "removed_symbols")


@_query(" UNION ALL ".join(f"SELECT '{s.split('_')[0]}' AS operation, s.symbol_type AS symbol_type, count(*) AS n FROM (SELECT unnest({s}) AS s FROM {_FIRST}) GROUP BY ALL" for s in _SYMBOLS))
def symbol_histogram(spark: SparkSession, d: str) -> DataFrame:
    return ch.symbol_histogram(ch.first_arrivals(table(spark, d, "code_changes"), *_SYMBOLS))


@_query(f"""SELECT change_no, array_to_string(list_sort(list_filter(list_distinct(imports_added), lambda x: NOT list_contains(imports_removed, x))), ',') AS gained,
    array_to_string(list_sort(list_filter(list_distinct(imports_removed), lambda x: NOT list_contains(imports_added, x))), ',') AS lost FROM {_FIRST}""")
def import_deltas(spark: SparkSession, d: str) -> DataFrame:
    deltas = ch.import_deltas(ch.first_arrivals(table(spark, d, "code_changes"), "imports_added", "imports_removed"))
    return deltas.select("change_no", F.array_join("gained", ",").alias("gained"), F.array_join("lost", ",").alias("lost"))


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_EXT = "lower(regexp_extract(regexp_extract(file_path, '([^/]*)$', 1), '^.+\\.([^.]*)$', 1))"
_LOWER = "lower(regexp_extract(file_path, '([^/]*)$', 1))"
_TEXTS = "lower(array_to_string(list_transform(added_symbols, lambda s: s.name), ' ') || ' ' || array_to_string(list_transform(modified_symbols, lambda s: s.name), ' ') || ' ' || array_to_string(list_transform(removed_symbols, lambda s: s.name), ' ') || ' ' || coalesce(summary, ''))"
_KIND = f"""CASE WHEN {_EXT} IN {_in(DOC_EXTENSIONS)} THEN 'documentation'
    WHEN {_LOWER} IN {_in(ch.CONFIG_FILES)} OR {_EXT} IN {_in(ch.CONFIG_SUFFIXES)} OR regexp_matches({_LOWER}, '{"|".join(ch.CONFIG_WORDS)}') THEN 'configuration'
    WHEN len(renamed_symbols) > 0 THEN 'rename' WHEN change_type = 'renamed' AND len(added_symbols) = 0 AND len(modified_symbols) = 0 AND len(removed_symbols) = 0 THEN 'rename'
    WHEN len(added_symbols) = 0 AND len(modified_symbols) = 0 AND len(removed_symbols) = 0 AND len(imports_added) = 0 AND len(imports_removed) = 0 THEN 'logic'
    WHEN regexp_matches({_TEXTS}, '{"|".join(ch.HELPER_WORDS)}') AND len(added_symbols) > 0 AND len(modified_symbols) = 0 THEN 'added_helper'
    WHEN len(added_symbols) > 0 OR len(removed_symbols) > 0 OR len(modified_symbols) > 0 THEN 'structural_update' ELSE 'logic' END"""
_KIND_COLUMNS = ("repository", "current_commit", "file_path", "change_type", "summary", *_SYMBOLS, "renamed_symbols", "imports_added", "imports_removed")


@_query(f"SELECT change_no, {_KIND} AS kind FROM {_FIRST}")
def change_kinds(spark: SparkSession, d: str) -> DataFrame:
    return ch.first_arrivals(table(spark, d, "code_changes"), *_KIND_COLUMNS).select("change_no", ch.change_kind().alias("kind"))


@_query(f"SELECT repository, current_commit, count(DISTINCT file_path) AS files, arg_min(kind, list_position([{', '.join(repr(k) for k in ch.KIND_ORDER)}], kind)) AS kind FROM (SELECT *, {_KIND} AS kind FROM {_FIRST}) GROUP BY ALL")
def commit_kinds(spark: SparkSession, d: str) -> DataFrame:
    return ch.commit_kinds(ch.first_arrivals(table(spark, d, "code_changes"), *_KIND_COLUMNS))


@_query("""WITH e AS (SELECT delivery_no, unnest(commits) AS c, generate_subscripts(commits, 1) AS i FROM push_payloads),
    f AS (SELECT delivery_no, 'added' AS operation, i, unnest(c.added) AS file_path, generate_subscripts(c.added, 1) AS j FROM e UNION ALL SELECT delivery_no, 'modified', i, unnest(c.modified), generate_subscripts(c.modified, 1) FROM e
        UNION ALL SELECT delivery_no, 'removed', i, unnest(c.removed), generate_subscripts(c.removed, 1) FROM e),
    m AS (SELECT delivery_no, operation, file_path, min((i, j)) AS mention FROM f GROUP BY ALL)
    SELECT delivery_no, operation, row_number() OVER (PARTITION BY delivery_no, operation ORDER BY mention) AS position, file_path FROM m""")
def pushed_files(spark: SparkSession, d: str) -> DataFrame:
    return ch.pushed_files(table(spark, d, "push_payloads"))


@_query("""SELECT delivery_no, regexp_replace(ref_name, '^refs/heads/', '') AS branch, split_part(repository.full_name, '/', 1) AS owner_slug,
    coalesce(regexp_extract(head_commit.committed_at, '^(\\d{4}-\\d{2}-\\d{2})', 1), '') AS commit_date, coalesce(regexp_extract(head_commit.committed_at, 'T(\\d{2}:\\d{2}:\\d{2})', 1), '') AS commit_time, len(commits) AS commits FROM push_payloads WHERE ref_name IS NOT NULL AND repository.full_name IS NOT NULL""")
def push_references(spark: SparkSession, d: str) -> DataFrame:
    at = F.coalesce(F.col("head_commit.committed_at"), F.lit(""))
    rows = table(spark, d, "push_payloads").where("ref_name is not null and repository.full_name is not null")
    return rows.select("delivery_no", text.branch(F.col("ref_name")).alias("branch"), F.split("repository.full_name", "/")[0].alias("owner_slug"), text.local_date(at).alias("commit_date"), text.local_time(at).alias("commit_time"), F.size("commits").cast("long").alias("commits"))


@_query("""SELECT full_name AS repository, sha, author_date, message FROM (SELECT *, row_number() OVER (PARTITION BY full_name ORDER BY author_date DESC, sha) AS n FROM
    (SELECT DISTINCT repository.full_name AS full_name, substring(c.id, 1, 8) AS sha, c.committed_at AS author_date, split_part(c.message, chr(10), 1) AS message FROM (SELECT repository, unnest(commits) AS c FROM push_payloads) WHERE c.id IS NOT NULL AND repository.full_name IS NOT NULL)) WHERE n <= 15""")
def repository_history(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "push_payloads").select(F.col("repository.full_name").alias("repository"), F.explode("commits").alias("c")).where("c.id is not null and repository is not null")
    rows = c.select("repository", F.substring("c.id", 1, 8).alias("sha"), F.col("c.committed_at").alias("author_date"), F.split("c.message", "\n")[0].alias("message")).distinct()
    order = W.partitionBy("repository").orderBy(F.col("author_date").desc(), "sha")
    return rows.withColumn("n", F.row_number().over(order)).where("n <= 15").drop("n")


_NOW = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC, active DESC, content_hash DESC) AS n FROM chunks) WHERE n = 1)"
_INDEX = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY run_no DESC, active DESC, content_hash DESC) AS n FROM indexed_chunks) WHERE n = 1)"
_ACTIONS = f"""(SELECT coalesce(n.chunk_id, o.chunk_id) AS chunk_id, coalesce(n.repository, o.repository) AS repository, CASE
    WHEN n.active AND o.chunk_id IS NULL THEN 'add' WHEN n.active AND n.content_hash IS DISTINCT FROM o.content_hash THEN 'update' WHEN n.active AND NOT o.active THEN 'restore' WHEN n.active THEN 'skip' WHEN o.active THEN 'delete' END AS action
    FROM {_INDEX} o FULL JOIN {_NOW} n ON n.chunk_id = o.chunk_id)"""


def _index(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.index_state(table(spark, d, "indexed_chunks"))


def _now(spark: SparkSession, d: str) -> DataFrame:
    return newest(table(spark, d, "chunks"), "repository", "content_hash", "active")


@_query(f"SELECT * FROM {_ACTIONS} WHERE action IS NOT NULL")
def index_actions(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.actions(_index(spark, d), _now(spark, d))


@_query(f"SELECT repository, action, count(*) AS n FROM {_ACTIONS} WHERE action IS NOT NULL GROUP BY ALL")
def index_action_counts(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.actions(_index(spark, d), _now(spark, d)).groupBy("repository", "action").agg(F.count("*").alias("n"))


@_query(f"SELECT chunk_id, 'left' AS only_in FROM {_INDEX} WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks) UNION ALL SELECT DISTINCT chunk_id, 'right' FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM indexed_chunks)")
def index_differences(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.differing_ids(table(spark, d, "indexed_chunks"), table(spark, d, "chunks"))


@_query(f"SELECT repository, count(*) AS total, count_if(NOT active) AS deleted, count_if(NOT active) / count(*) >= 0.25 AS needs_rebuild FROM {_INDEX} GROUP BY repository")
def compaction_due(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.compaction(_index(spark, d))


@_query(f"WITH i AS {_INDEX}, due AS (SELECT repository FROM i GROUP BY repository HAVING count_if(NOT active) / count(*) >= 0.25) SELECT chunk_id, repository, content_hash, active FROM i WHERE active OR repository NOT IN (SELECT repository FROM due)")
def compacted_index(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.compacted(_index(spark, d))


_RUNS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_no ORDER BY updated_at DESC) AS n FROM index_runs) WHERE n = 1)"
_TRIED = f"tried AS (SELECT *, row_number() OVER (PARTITION BY repository, current_commit ORDER BY run_no) AS cycle FROM {_RUNS} WHERE status IN ('completed', 'failed'))"


def _tried(spark: SparkSession, d: str) -> DataFrame:
    return quality.attempts(final_runs(table(spark, d, "index_runs")))


@_query(f"""WITH {_TRIED}, last AS (SELECT repository, current_commit, arg_max(status, cycle) AS status, max(cycle) AS cycles FROM tried GROUP BY ALL)
    SELECT (SELECT round(avg(CAST(status = 'completed' AS DOUBLE)), 6) FROM tried WHERE cycle = 1) AS first_pass_rate, count(*) AS commits, round(avg(CAST(status = 'completed' AS DOUBLE)), 6) AS final_pass_rate,
    round(avg(CAST(status = 'failed' AS DOUBLE)), 6) AS failed_rate, round(avg(CASE WHEN status = 'completed' THEN cycles END), 6) AS mean_cycles FROM last""")
def attempt_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = quality.attempt_statistics(_tried(spark, d))
    return s.select(*(c if c == "commits" else F.round(c, 6).alias(c) for c in s.columns))


@_query(f"WITH {_TRIED} SELECT cycle, count(*) AS runs, round(avg(epoch_us(finished_at) - epoch_us(started_at)) / 1e6, 4) AS mean_seconds FROM tried GROUP BY cycle")
def mean_by_cycle(spark: SparkSession, d: str) -> DataFrame:
    return quality.mean_by_cycle(_tried(spark, d)).withColumn("mean_seconds", F.round("mean_seconds", 4))


@_query("""SELECT workflow_id, status, rag_stage, rag_progress, states, furthest FROM (SELECT workflow_id, arg_max(struct_pack(status := status, rag_stage := rag_stage, rag_progress := rag_progress), (state_time, state_no)) AS x,
    count(*) AS states, max(rag_progress) AS furthest FROM (SELECT *, replace(state_time, 'Z', '') AS t FROM workflow_states WHERE workflow_id IS NOT NULL) GROUP BY workflow_id), LATERAL (SELECT x.status AS status, x.rag_stage AS rag_stage, x.rag_progress AS rag_progress)""")
def workflow_latest(spark: SparkSession, d: str) -> DataFrame:
    return workflow_state(table(spark, d, "workflow_states").where("workflow_id is not null"))


@_query("SELECT repository, state_no, workflow_id, position FROM (SELECT repository, state_no, workflow_id, row_number() OVER (PARTITION BY repository ORDER BY received_at DESC, state_no DESC) AS position FROM workflow_states WHERE repository IS NOT NULL) WHERE position <= 10")
def recent_states(spark: SparkSession, d: str) -> DataFrame:
    order = W.partitionBy("repository").orderBy(F.col("received_at").desc(), F.col("state_no").desc())
    rows = table(spark, d, "workflow_states").where("repository is not null").select("repository", "state_no", "workflow_id", "received_at")
    return rows.withColumn("position", F.row_number().over(order)).where("position <= 10").drop("received_at")


@_query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return tumbling_windows(table(spark, d, "events"), "1 hour").withColumn("total", F.round("total", 4))


@_query("""SELECT w AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 2 HOUR]) AS w FROM events) GROUP BY ALL""")
def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    return sliding_windows(table(spark, d, "events"), "3 hours", "1 hour").withColumn("total", F.round("total", 4))


@_query("""WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 1800000000 THEN 0 ELSE 1 END AS opens FROM events))
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, session""")
def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    return session_windows(table(spark, d, "events"), "30 minutes")


@_query("""SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count_if(json_extract_string(props, '$.k') IS NULL) AS without FROM events GROUP BY event_type""")
def event_properties(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "struct<k: long>")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.count_if(k.isNull()).alias("without"))


@_query(f"""WITH t AS (SELECT DISTINCT change_no AS key, greatest(1, s.start_line + 1) AS line FROM (SELECT change_no, unnest(list_concat(added_symbols, removed_symbols)) AS s FROM {_FIRST}) WHERE s.start_line IS NOT NULL AND s.name IS NOT NULL AND s.symbol_type IS NOT NULL),
    i AS (SELECT *, line - row_number() OVER (PARTITION BY key ORDER BY line) AS island FROM t)
    SELECT key, min(line) AS first_line, max(line) AS last_line FROM i GROUP BY key, island""")
def diff_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Hunks made of each change's symbols, as a unified diff would show them."""
    c = ch.first_arrivals(table(spark, d, "code_changes"), "added_symbols", "removed_symbols")
    hunk = lambda sign: lambda s: F.concat(F.lit("@@ -"), s["start_line"], F.lit(",2 +"), s["start_line"], F.lit(",2 @@\n "), s["name"], F.lit(f"\n{sign}"), s["symbol_type"])
    diff = F.array_join(F.concat(F.transform("added_symbols", hunk("+")), F.transform("removed_symbols", hunk("-"))), "\n")
    return ch.changed_lines(c.select(F.col("change_no").alias("key"), diff.alias("diff")).where("diff <> ''"))

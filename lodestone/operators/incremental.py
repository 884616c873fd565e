"""Processing only records that are new or changed since the last run that finished.

`Window` says which rows of a table are new: those beyond the watermark of the last commit, up to a limit that is fixed when
the run starts. Rows that come late, with a sequence below the watermark, are taken by a second rule: they stand in a file that
is younger than the youngest one the last run saw. Both are filters on the scan, so older files and row groups aren't read.
`IncrementalRun` runs any function over the new rows of one table; `next_work_list` keeps up an indexer's work list from four.
Output and watermark become visible in one commit; a run that dies leaves both where they were, and the next takes the same rows.

The work list needs a record's whole history, so a commit holds what is left of it: a row for each run, chunk and change and
the rows of runs that aren't completed yet. A run reads that, and new rows. If a run that was completed turns out not to be (a later
state says so), what chunks took is made anew from the whole of `indexed_chunks`; that is the only case in which old rows are read.

Defined results
- null run_no, chunk_id or change_no: the row is ignored
- a null sequence: the row is taken when its file is new (without files: by the first run)
- two states of a run with one updated_at: the later stage of the life cycle counts (completed, failed, in_progress, pending)
- repeated rows: count once; empty tables: an empty list, or, without runs, every record
- null content_hash or active: null equals null and nothing else
- a null previous_commit or current_commit equals nothing, so such a change stays on the list; so does one without recorded_at
- rows of a run without new rows: those of the last commit; further columns are never read
- files must be complete when they are listed and not change afterwards
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.ledger import Commit, Ledger
from lodestone.sources.tables import ARRIVED

_LIFE_CYCLE = ("pending", "in_progress", "failed", "completed")
#: The tables of a work list, each with the column that rises as rows are added.
SEQUENCES = {"chunks": "created_at", "code_changes": "recorded_at", "index_runs": "updated_at", "indexed_chunks": "run_no"}


class Window:
    """The rows of df that the commit with watermark `last` hasn't taken, up to `upper`.

    A watermark has the highest sequence taken, the highest seen, and the time of the youngest file seen.
    """

    def __init__(self, df: DataFrame, sequence: str, last: dict[str, Any] | None, upper: str | None, seen: str | None, arrived: str | None):
        self.df, self.sequence, self.last = df, sequence, last or {}
        self.upper, self.seen, self.arrived = upper, seen, arrived
        self._kind = dict(df.dtypes)[sequence]

    @property
    def watermark(self) -> dict[str, Any]:
        return {"sequence": self.upper, "seen": self.seen, "arrived": self.arrived}

    @property
    def is_empty(self) -> bool:
        return bool(self.last) and self.last == self.watermark

    def up_to(self) -> DataFrame:
        """All rows up to the limit, old ones too."""
        seq = F.col(self.sequence)
        return self.df.where(seq.isNull() if self.upper is None else seq.isNull() | (seq <= F.lit(self.upper).cast(self._kind)))

    @property
    def rows(self) -> DataFrame:
        if not self.last:
            return self.up_to()
        lower = self.last["sequence"]
        fresh: Column = F.lit(False) if lower is None else F.col(self.sequence) > F.lit(lower).cast(self._kind)
        if lower is None:
            fresh = F.col(self.sequence).isNotNull()
        if ARRIVED in self.df.columns and self.last["arrived"] is not None:
            fresh = fresh | (F.col(ARRIVED) > F.lit(self.last["arrived"]).cast("timestamp"))
        elif ARRIVED in self.df.columns:
            fresh = F.lit(True)
        return self.up_to().where(fresh)


def windows(sources: dict[str, tuple[DataFrame, str]], after: dict[str, Any] | None, limits: dict[str, Any] | None = None) -> dict[str, Window]:
    """A window for each source; how far the tables go is read in one job, and only from files younger than the last run's."""
    after, limits, parts = after or {}, limits or {}, []
    for name, (df, seq) in sources.items():
        last = after.get(name) or {}
        has_files = ARRIVED in df.columns
        young = df.where(F.col(ARRIVED) > F.lit(last["arrived"]).cast("timestamp")) if has_files and last.get("arrived") else df
        kind = dict(df.dtypes)[seq]
        seen = F.greatest(F.max(seq), F.lit(last.get("seen")).cast(kind))
        arrived = F.greatest(F.max(ARRIVED), F.lit(last.get("arrived")).cast("timestamp")) if has_files else F.lit(None).cast("timestamp")
        limit = F.lit(limits.get(name)).cast(kind)
        upper = F.when(limit < seen, limit).otherwise(seen)
        parts.append(young.agg(F.lit(name).alias("name"), seen.cast("string").alias("seen"), arrived.cast("string").alias("arrived"), upper.cast("string").alias("upper")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    found = {r.name: r for r in whole.collect()}
    return {n: Window(df, seq, after.get(n), found[n].upper, found[n].seen, found[n].arrived) for n, (df, seq) in sources.items()}


class IncrementalRun:
    """One run over the new rows of `source`; `finish` writes the output and commits it together with the new watermark."""

    def __init__(self, ledger: Ledger, source: DataFrame, sequence: str):
        self.ledger = ledger
        self.after: Commit | None = ledger.latest()
        self.window = windows({"source": (source, sequence)}, self.after.watermark if self.after else None)["source"]
        self.rows = self.window.rows

    def finish(self, process: Callable[[DataFrame], DataFrame]) -> Commit:
        if self.window.is_empty:
            return self.after
        data = None if self.window.seen is None and self.window.arrived is None else self.ledger.stage(process(self.rows))
        return self.ledger.commit(self.after, {"source": self.window.watermark}, data)


def _run_state() -> Column:
    """Orders the states of a run: by updated_at, then by stage."""
    stage = F.array_position(F.array(*map(F.lit, _LIFE_CYCLE)), F.coalesce("status", F.lit("")))
    return F.struct("updated_at", stage.alias("stage"), "repository", "previous_commit", "current_commit", "status", "started_at", "finished_at")


def final_runs(index_runs: DataFrame) -> DataFrame:
    """One row for each run_no in its final state, the one of the latest updated_at."""
    fields = ("repository", "previous_commit", "current_commit", "status", "started_at", "finished_at")
    newest = index_runs.where("run_no is not null").groupBy("run_no").agg(F.max(_run_state()).alias("state"))
    return newest.select("run_no", *(f"state.{f}" for f in fields))


def _runs(new: DataFrame, old: DataFrame | None) -> DataFrame:
    """run_no, its final state, and whether the last commit took it for completed."""
    each = new.where("run_no is not null").select("run_no", _run_state().alias("state"), F.lit(False).alias("was"))
    if old is not None:
        each = each.unionByName(old.select("run_no", "state", (F.col("state.status") == "completed").alias("was")))
    return each.groupBy("run_no").agg(F.max("state").alias("state"), F.coalesce(F.max("was"), F.lit(False)).alias("was"))


def _chunks(new: DataFrame, taken: DataFrame, old: DataFrame | None) -> DataFrame:
    """chunk_id, its current state, and the one that the completed run of highest run_no took."""
    now = F.struct("created_at", F.coalesce("active", F.lit(False)).alias("first"), "content_hash", "active")
    a = new.where("chunk_id is not null").select("chunk_id", now.alias("now"))
    b = taken.select("chunk_id", F.struct("run_no", "content_hash", "active").alias("taken"))
    each = a.unionByName(b, True)
    return (each if old is None else each.unionByName(old, True)).groupBy("chunk_id").agg(F.max("now").alias("now"), F.max("taken").alias("taken"))


def _changes(new: DataFrame, old: DataFrame | None) -> DataFrame:
    """change_no and its earliest row: when it arrived, where, between which commits."""
    never = F.lit("9999-12-31").cast(dict(new.dtypes)["recorded_at"])
    first = F.struct(F.coalesce("recorded_at", never).alias("arrived"), "repository", "previous_commit", "current_commit")
    each = new.where("change_no is not null").select("change_no", first.alias("first"))
    return (each if old is None else each.unionByName(old)).groupBy("change_no").agg(F.min("first").alias("first"))


def _work(runs: DataFrame, chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """(record_kind, record_key) of what no completed run has taken."""
    same = F.col("taken").isNotNull() & F.col("taken.content_hash").eqNullSafe(F.col("now.content_hash")) & F.col("taken.active").eqNullSafe(F.col("now.active"))
    a = chunks.where(F.col("now").isNotNull() & ~same).select(F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("record_key"))
    key = ["repository", "previous_commit", "current_commit"]
    # The latest start of the runs between two commits is enough: if any run took the change, that one did.
    starts = runs.where("state.status = 'completed'").groupBy(*(F.col(f"state.{k}").alias(k) for k in key)).agg(F.max("state.started_at").alias("last_start"))
    each = changes.select("change_no", F.col("first.arrived").alias("arrived"), *(F.col(f"first.{k}").alias(k) for k in key))
    taken = F.coalesce(F.col("last_start") >= F.col("arrived"), F.lit(False))
    b = each.join(starts, key, "left").where(~taken).select(F.lit("change").alias("record_kind"), F.col("change_no").cast("string").alias("record_key"))
    return a.unionByName(b)


def next_work_list(ledger: Ledger, tables: dict[str, DataFrame], limits: dict[str, Any] | None = None) -> Commit:
    """One run: takes the new rows of the four tables (see SEQUENCES) into the state, and commits state, work list and watermarks.

    limits may hold a table's rows back beyond a value of its sequence; without, all that is there when the run starts is taken.
    """
    after = ledger.latest()
    window = windows({n: (tables[n], seq) for n, seq in SEQUENCES.items()}, after.watermark if after else None, limits)
    if after and all(w.is_empty for w in window.values()):
        return after
    old = (lambda name: ledger.part(after, name)) if after else (lambda name: None)
    folder = ledger.folder()
    runs = ledger.put(folder, "runs", _runs(window["index_runs"].rows, old("runs")))
    revoked = after is not None and runs.where("was and not (state.status <=> 'completed')").limit(1).count() > 0
    indexed = (window["indexed_chunks"].up_to() if revoked else window["indexed_chunks"].rows).where("chunk_id is not null and run_no is not null")
    indexed = indexed.select("run_no", "chunk_id", "content_hash", "active")
    if after and not revoked:
        indexed = indexed.unionByName(old("waiting"))
    done = runs.where("state.status = 'completed'").select("run_no")
    ledger.put(folder, "waiting", indexed.join(done, "run_no", "left_anti").distinct())
    known = old("chunks")
    if revoked:
        known = known.select("chunk_id", "now")
    chunks = ledger.put(folder, "chunks", _chunks(window["chunks"].rows, indexed.join(done, "run_no", "left_semi"), known))
    changes = ledger.put(folder, "changes", _changes(window["code_changes"].rows, old("changes")))
    ledger.put(folder, "work", _work(runs, chunks, changes))
    return ledger.commit(after, {n: w.watermark for n, w in window.items()}, folder)


def limits_at(tables: dict[str, DataFrame], share: float) -> dict[str, str]:
    """The values at this share of the way from the lowest to the highest of each table's sequence."""
    parts = [tables[n].agg(F.lit(n).alias("name"), F.expr(f"cast(cast(min({s}) + (max({s}) - min({s})) * {share} as {dict(tables[n].dtypes)[s]}) as string)").alias("at")) for n, s in SEQUENCES.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return {r.name: r.at for r in whole.collect()}

"""Old against new: what to add, update, restore, skip and delete in an index, and when to compact it.

An index is a Parquet table in versions (`sources.ledger`); a change writes a new version beside the old one and commits it,
so readers see the one or the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.ledger import Commit, Ledger


def index_state(indexed: DataFrame) -> DataFrame:
    """(chunk_id, repository, content_hash, active): what the run of the highest number left of each chunk."""
    order = F.struct("run_no", "active", "content_hash")
    state = F.max_by(F.struct("repository", "content_hash", "active"), order)
    return indexed.where("chunk_id is not null").groupBy("chunk_id").agg(state.alias("x")).select("chunk_id", "x.*")


def actions(old: DataFrame, new: DataFrame) -> DataFrame:
    """(chunk_id, repository, action) for an index `old` and the chunks `new`, both (chunk_id, repository, content_hash, active).

    In both, with one hash: skip, or restore where the index has it inactive; with another hash: update. Only new and active: add.
    In the index and active, but not in `new` or inactive there: delete.
    """
    o = old.select("chunk_id", F.col("repository").alias("o_repository"), F.col("content_hash").alias("o_hash"), F.coalesce("active", F.lit(False)).alias("o_active"), F.lit(True).alias("o"))
    n = new.select("chunk_id", "repository", "content_hash", F.coalesce("active", F.lit(False)).alias("active"), F.lit(True).alias("n"))
    wanted = F.coalesce(F.col("n") & F.col("active"), F.lit(False))
    action = (
        F.when(wanted & F.col("o").isNull(), "add")
        .when(wanted & ~F.col("content_hash").eqNullSafe(F.col("o_hash")), "update")
        .when(wanted & ~F.col("o_active"), "restore")
        .when(wanted, "skip")
        .when(F.col("o_active"), "delete")
    )
    return o.join(n, "chunk_id", "full_outer").select("chunk_id", F.coalesce("repository", "o_repository").alias("repository"), action.alias("action")).where("action is not null")


def applied(old: DataFrame, new: DataFrame) -> DataFrame:
    """The index after `actions(old, new)`: new rows win, rows that are gone stay as inactive."""
    o = old.select("chunk_id", F.struct("repository", "content_hash", "active").alias("o"))
    n = new.select("chunk_id", F.struct("repository", "content_hash", F.coalesce("active", F.lit(False)).alias("active")).alias("n"))
    gone = F.struct(F.col("o.repository").alias("repository"), F.col("o.content_hash").alias("content_hash"), F.lit(False).alias("active"))
    return o.join(n, "chunk_id", "full_outer").select("chunk_id", F.coalesce("n", gone).alias("x")).select("chunk_id", "x.*")


def differing_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    """(chunk_id, only_in): ids in one of the two tables only."""
    a, b = left.select("chunk_id").distinct(), right.select("chunk_id").distinct()
    return a.join(b, "chunk_id", "left_anti").withColumn("only_in", F.lit("left")).unionByName(b.join(a, "chunk_id", "left_anti").withColumn("only_in", F.lit("right")))


def compaction(index: DataFrame, least: float = 0.25) -> DataFrame:
    """(repository, total, deleted, needs_rebuild): a repository is rewritten once `least` of its rows are deleted."""
    counted = index.groupBy("repository").agg(F.count("*").alias("total"), F.count_if(~F.coalesce("active", F.lit(False))).alias("deleted"))
    return counted.withColumn("needs_rebuild", F.col("deleted") / F.col("total") >= least)


def compacted(index: DataFrame, least: float = 0.25) -> DataFrame:
    due = compaction(index, least).where("needs_rebuild").select("repository")
    keep = index.where(F.coalesce("active", F.lit(False)))
    return index.join(due, "repository", "left_anti").unionByName(keep.join(due, "repository", "left_semi"))


def publish(ledger: Ledger, table: DataFrame, **info) -> Commit:
    """Makes table the current version."""
    after = ledger.latest()
    return ledger.commit(after, {"version": (after.version if after else 0) + 1}, ledger.stage(table), **info)


def current(ledger: Ledger, schema=None) -> DataFrame | None:
    """The version committed last; earlier ones stay readable by their commits."""
    commit = ledger.latest()
    if commit is None:
        return None
    reader = ledger.spark.read
    return (reader.schema(schema) if schema is not None else reader).parquet(commit.data)

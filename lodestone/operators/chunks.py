"""Statistics, validation, filters and line ranges of chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.ids import combined
from lodestone.functions.text import SPACE

#: Columns that tell two states of a chunk apart, newest first; the rest breaks ties.
_STATE = ("created_at", "active", "content_hash")


def newest(chunks: DataFrame, *columns: str) -> DataFrame:
    """The newest state of each chunk_id. Only the columns asked for are shuffled; nothing is sorted."""
    order = F.struct(*(F.col(c) for c in _STATE))
    return chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.max_by(F.struct(*columns), order).alias("x")).select("chunk_id", "x.*")


def statistics(chunks: DataFrame, *by: str) -> DataFrame:
    """Counters that add up over any split of the rows."""
    code = F.col("chunk_type") == "code"
    return chunks.groupBy(*by).agg(
        F.count("*").alias("chunks"),
        F.count_if(code).alias("code_chunks"),
        F.count_if(F.col("chunk_type") == "documentation").alias("doc_chunks"),
        F.count_if(code & F.col("symbol_name").isNull()).alias("module_chunks"),
        F.count_if(F.col("symbol_name").isNotNull()).alias("symbol_chunks"),
        F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("tokens"),
        F.count_distinct("file_path").alias("files"),
    )


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"^{SPACE}*$")


def violations(chunks: DataFrame) -> DataFrame:
    """(level, code, n): how many rows break each rule, and how many rows repeat a chunk_id."""
    rules = [
        ("error", "empty_content", blank(F.col("content"))),
        ("error", "bad_range", (F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line"))),
        ("warning", "no_tokens", F.coalesce(F.col("token_count"), F.lit(0)) <= 0),
    ]
    counted = chunks.agg(*(F.count_if(rule).alias(code) for _, code, rule in rules))
    rows = counted.select(F.explode(F.array(*(F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), F.col(code).alias("n")) for level, code, _ in rules))).alias("x")).select("x.*")
    repeats = chunks.groupBy("chunk_id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).select(F.lit("error").alias("level"), F.lit("duplicate_id").alias("code"), "n")
    return rows.unionByName(repeats)


def filter_chain(chunks: DataFrame, repository: str | None = None, languages: list[str] | None = None, chunk_types: list[str] | None = None, score: str | None = None, threshold: float = 0.0, **metadata: str) -> DataFrame:
    """chunks with `removed_by`: the first filter of the chain that drops the row, null for rows that stay.

    Filters in order: inactive or blank, repository, language (no list: all), score, chunk type, further columns compared as text.
    """
    drops: list[tuple[str, Column]] = [("inactive", ~F.coalesce(F.col("active"), F.lit(False)) | blank(F.col("content")))]
    if repository is not None:
        drops.append(("repository", ~F.col("repository").eqNullSafe(F.lit(repository))))
    if languages:
        drops.append(("language", ~F.coalesce(F.lower(F.trim("prog_lang")).isin([x.lower() for x in languages]), F.lit(False))))
    if score is not None:
        drops.append(("similarity", ~F.coalesce(F.col(score) >= threshold, F.lit(False))))
    if chunk_types:
        drops.append(("chunk_type", ~F.coalesce(F.col("chunk_type").isin(chunk_types), F.lit(False))))
    for column, value in metadata.items():
        drops.append((column, ~F.col(column).cast("string").eqNullSafe(F.lit(value)) if column in chunks.columns else F.lit(True)))
    first = F.lit(None).cast("string")
    for name, drop in reversed(drops):
        first = F.when(drop, name).otherwise(first)
    return chunks.withColumn("removed_by", first)


def file_digests(chunks: DataFrame) -> DataFrame:
    """One digest a file from its current chunks' hashes, whatever their order; a file's chunks are few."""
    return newest(chunks, "repository", "file_path", "content_hash").groupBy("repository", "file_path").agg(F.count("*").alias("chunks"), combined(F.collect_list("content_hash")).alias("digest"))


def covered_ranges(chunks: DataFrame) -> DataFrame:
    """(repository, file_path, first_line, last_line): the lines of a file that some chunk covers, as few ranges as possible."""
    file = W.partitionBy("repository", "file_path")
    order = file.orderBy("start_line", "end_line")
    rows = chunks.where("start_line >= 1 and end_line >= start_line").select("repository", "file_path", "start_line", "end_line").distinct()
    reached = F.max("end_line").over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(reached.isNull() | (F.col("start_line") > reached + 1), 1).otherwise(0)
    island = F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("opens", opens).withColumn("island", island).groupBy("repository", "file_path", "island").agg(F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line")).drop("island")


def uncovered_ranges(chunks: DataFrame) -> DataFrame:
    """The ranges between the covered ones, and the one before the first."""
    before = F.lag("last_line", 1, 0).over(W.partitionBy("repository", "file_path").orderBy("first_line"))
    gaps = covered_ranges(chunks).select("repository", "file_path", (before + 1).alias("first_line"), (F.col("first_line") - 1).alias("last_line"))
    return gaps.where("first_line <= last_line")


def state_history(chunks: DataFrame) -> DataFrame:
    """Each distinct state of a chunk with the state before it; a chunk has few states."""
    order = W.partitionBy("chunk_id").orderBy("created_at", "active")
    states = chunks.where("chunk_id is not null").select("chunk_id", "created_at", "active").distinct()
    return states.withColumns({"version": F.row_number().over(order), "was_active": F.lag("active").over(order)})

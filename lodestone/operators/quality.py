"""Scores of Markdown documents, and statistics of run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import SPACE, empty_headings, fence_count

#: Sections a file's document must have, and what a finding costs.
FILE_SECTIONS = ["## Overview", "## Change Summary", "## Key Components"]
WARNING_COST, DEFAULT_ACCURACY = 5, 80.0


def structure(documents: DataFrame, key: str, path: Column, text: str) -> DataFrame:
    """(key, empty, missing, fences, empty_headings, warnings, formatting, completeness, accuracy, score) of each document.

    A path with a folder is a file's document, with three expected sections; others have one, which any second-level heading
    stands for. Empty documents score 0.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    empty = t.rlike(f"^{SPACE}*$")
    of_file = path.contains("/")
    low = F.lower(t)
    lacks = [(~low.contains(s.lower())).cast("int") for s in FILE_SECTIONS]
    missing = F.when(of_file, lacks[0] + lacks[1] + lacks[2]).otherwise(F.when(t.contains("## "), 0).otherwise(lacks[0]))
    expected = F.when(of_file, 3).otherwise(1)
    rows = documents.select(F.col(key), empty.alias("empty"), missing.alias("missing"), expected.alias("expected"), fence_count(t).alias("fences"), empty_headings(t).alias("empty_headings"))
    warnings = (F.col("fences") % 2 != 0).cast("int") + (F.col("empty_headings") > 0).cast("int")
    rows = rows.withColumn("warnings", F.when(F.col("empty"), 0).otherwise(warnings))
    zero = lambda c: F.when(F.col("empty"), 0.0).otherwise(c)
    rows = rows.withColumns({"formatting": zero(F.greatest(F.lit(0.0), 100.0 - F.col("warnings") * WARNING_COST)), "completeness": zero(F.greatest(F.lit(0.0), 100.0 - F.col("missing") / F.col("expected") * 100)), "accuracy": zero(F.lit(DEFAULT_ACCURACY))})
    return rows.withColumn("score", F.round((F.col("formatting") + F.col("completeness") + F.col("accuracy")) / 3, 1)).drop("expected")


def overall(scored: DataFrame, *by: str) -> DataFrame:
    """Weighted score of groups of scored documents; the weights applied sum to 0.9 and are divided out."""
    g = scored.groupBy(*by).agg(F.count("*").alias("documents"), F.avg("completeness").alias("c"), F.avg("accuracy").alias("a"), F.avg("formatting").alias("m"), F.sum("warnings").alias("warnings"))
    readable = F.greatest(F.lit(0.0), 100.0 - F.col("warnings") * WARNING_COST)
    score = (F.col("c") * 0.25 + F.col("a") * 0.30 + 100.0 * 0.20 + F.col("m") * 0.10 + readable * 0.05) / 0.90
    return g.select(*by, "documents", "warnings", F.round(F.least(score, F.lit(100.0)), 1).alias("score"))


def attempts(runs: DataFrame) -> DataFrame:
    """Finished runs with `cycle`: the how-manieth of its commits' runs it is, 1 first. A pair of commits has few runs."""
    order = W.partitionBy("repository", "current_commit").orderBy("run_no")
    return runs.where("status in ('completed', 'failed')").withColumn("cycle", F.row_number().over(order))


def attempt_statistics(tried: DataFrame) -> DataFrame:
    """One row: share of first attempts that end well, of last ones that do and that fail, commits, mean attempts until it ended well."""
    last = tried.groupBy("repository", "current_commit").agg(F.max_by("status", "cycle").alias("status"), F.max("cycle").alias("cycles"))
    share = lambda c: F.avg(c.cast("double"))
    first = tried.where("cycle = 1").agg(share(F.col("status") == "completed").alias("first_pass_rate"))
    final = last.agg(F.count("*").alias("commits"), share(F.col("status") == "completed").alias("final_pass_rate"), share(F.col("status") == "failed").alias("failed_rate"), F.avg(F.when(F.col("status") == "completed", F.col("cycles"))).alias("mean_cycles"))
    return first.crossJoin(final)


def mean_by_cycle(tried: DataFrame) -> DataFrame:
    """(cycle, runs, mean_seconds)."""
    seconds = (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    return tried.groupBy("cycle").agg(F.count("*").alias("runs"), F.avg(seconds).alias("mean_seconds"))


#: The scores from which documents pass, with warnings or without; the least faithfulness; below what a weak pass is revised.
PASS, CLEAN_PASS, FAITHFUL, WEAK_PASS = 70.0, 85.0, 50.0, 75.0


def status(score: Column, faithfulness: Column | None = None) -> Column:
    """PASSED, PASSED_WITH_WARNINGS or FAILED; a null faithfulness wasn't judged."""
    band = F.when(score >= CLEAN_PASS, "PASSED").when(score >= PASS, "PASSED_WITH_WARNINGS").otherwise("FAILED")
    return band if faithfulness is None else F.when(faithfulness < FAITHFUL, "FAILED").otherwise(band)


def route(error: Column, verdict: Column, score: Column, cycles: Column, most: int = 2) -> Column:
    """Where documents go after validation: failed, sync or revision."""
    again = cycles < most
    return (
        F.when(F.coalesce(error, F.lit("")) != "", "failed")
        .when(verdict == "PASSED", "sync")
        .when(verdict == "PASSED_WITH_WARNINGS", F.when((score < WEAK_PASS) & again, "revision").otherwise("sync"))
        .otherwise(F.when(again, "revision").otherwise("failed"))
    )


def run_metrics(documents: DataFrame, seconds: float, test_files: int, source_files: int) -> DataFrame:
    """One row on a run over documents (content, quality, faithfulness): documents that aren't blank, seconds for each, mean scores, tests over sources."""
    n = F.count_if(~F.coalesce(F.col("content"), F.lit("")).rlike(f"^{SPACE}*$"))
    each = documents.agg(n.alias("documents"), F.round(F.avg("quality"), 1).alias("quality"), F.round(F.avg("faithfulness"), 1).alias("faithfulness"))
    ratio = round(test_files / source_files, 4) if source_files else 0.0
    return each.withColumns({"seconds": F.round(F.lit(float(seconds)), 2), "seconds_each": F.coalesce(F.round(F.try_divide(F.lit(float(seconds)), F.col("documents")), 2), F.lit(0.0)), "test_ratio": F.lit(ratio)})


def report(findings: DataFrame, by: str) -> DataFrame:
    """(by, level, n, messages) of findings (by, level, message): each message once, in order of text. A document has few findings."""
    return findings.groupBy(by, "level").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("message")).alias("messages"))


def prepended(old: Column, header: str, entry: Column) -> Column:
    """A changelog with a new entry first, under one header."""
    rest = F.regexp_replace(F.coalesce(old, F.lit("")), f"^\\s*\\Q{header}\\E\\s*", "")
    return F.when(rest == "", F.concat(F.lit(header + "\n\n"), entry)).otherwise(F.concat(F.lit(header + "\n\n"), entry, F.lit("\n\n"), rest))

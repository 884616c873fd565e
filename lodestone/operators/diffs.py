"""Two versions of files: what became of each file, and unified diffs of their texts."""

from __future__ import annotations

import difflib
import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_path, old_path, change) of two (file_path, content): added, deleted, modified, renamed; unchanged files are left out.

    A file that is gone and one that is new are one renamed file if their contents are equal and each is the only such by its
    place among the paths in order; contents are compared by hash, so they are not moved.
    """
    o = old.select(F.col("file_path").alias("path"), F.sha2("content", 256).alias("o"))
    n = new.select(F.col("file_path").alias("path"), F.sha2("content", 256).alias("n"))
    both = o.join(n, "path", "full_outer").where(~F.col("o").eqNullSafe(F.col("n")))
    place = lambda h: F.row_number().over(W.partitionBy(h).orderBy("path"))
    gone = both.where("n is null").select("path", F.col("o").alias("h")).withColumn("i", place("h"))
    fresh = both.where("o is null").select("path", F.col("n").alias("h")).withColumn("i", place("h"))
    pairs = gone.withColumnRenamed("path", "old_path").join(fresh, ["h", "i"], "full_outer")
    change = F.when(F.col("path").isNull(), "deleted").when(F.col("old_path").isNull(), "added").otherwise("renamed")
    moved = pairs.select(F.coalesce("path", "old_path").alias("file_path"), F.when(change == "renamed", F.col("old_path")).alias("old_path"), change.alias("change"))
    edited = both.where("o is not null and n is not null").select(F.col("path").alias("file_path"), F.lit(None).cast("string").alias("old_path"), F.lit("modified").alias("change"))
    return moved.unionByName(edited)


def _diff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        rows = []
        for key, old, new in zip(p["key"], p["old"], p["new"]):
            lines = list(difflib.unified_diff((old or "").splitlines(), (new or "").splitlines(), lineterm="", n=3))[2:]
            rows.append((key, "\n".join(lines), sum(x.startswith("+") for x in lines), sum(x.startswith("-") for x in lines)))
        yield pd.DataFrame(rows, columns=["key", "diff", "added", "removed"])


def unified_diffs(pairs: DataFrame) -> DataFrame:
    """(key, diff, added, removed) of (key, old, new); hunks with three lines around them, without a file header; a null text is empty."""
    return pairs.select(F.col("key").cast("string"), "old", "new").mapInPandas(_diff, "key string, diff string, added int, removed int")


def numbered_diff(diffs: DataFrame) -> DataFrame:
    """(key, position, kind, old_line, new_line, line): every line of a diff with its number on either side."""
    lines = diffs.select("key", F.posexplode(F.split("diff", "\n")).alias("position", "line")).where("line <> ''")
    order = W.partitionBy("key").orderBy("position")
    head = F.col("line").rlike("^@@ ")
    lines = lines.withColumn("hunk", F.sum(head.cast("int")).over(order))
    kind = F.when(head, "header").when(F.col("line").startswith("+"), "added").when(F.col("line").startswith("-"), "removed").otherwise("same")
    inside = W.partitionBy("key", "hunk").orderBy("position")
    start = lambda sign: F.first(F.regexp_extract("line", f"\\{sign}(\\d+)", 1).try_cast("int")).over(inside.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    before = lambda *kinds: F.coalesce(F.sum(F.col("kind").isin(*kinds).cast("int")).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumn("kind", kind).withColumns({"a": start("-"), "b": start("+")})
    old = F.when(F.col("kind").isin("removed", "same"), F.col("a") + before("removed", "same"))
    new = F.when(F.col("kind").isin("added", "same"), F.col("b") + before("added", "same"))
    return lines.select("key", "position", "kind", old.alias("old_line"), new.alias("new_line"), "line")


def signed(secret: str | None, body: Column, header: Column) -> Column:
    """Whether header is "sha256=" and the HMAC of body; without a secret everything is; nulls aren't."""
    if not secret:
        return F.lit(True)

    def check(bodies: pd.Series, headers: pd.Series) -> pd.Series:
        return pd.Series([b is not None and h is not None and hmac.compare_digest("sha256=" + hmac.new(secret.encode(), b.encode() if isinstance(b, str) else bytes(b), hashlib.sha256).hexdigest(), h) for b, h in zip(bodies, headers)], dtype=bool)

    return F.pandas_udf(check, "boolean")(body, header)


_COMMENT_LINE = "^(?:#|//|/\\*|\\*|--|<!--)"


def _lines(diff: Column) -> Column:
    return F.split(F.coalesce(diff, F.lit("")), "\n")


def added_code(diff: Column, most: int = 80) -> Column:
    """The first added lines of a diff that are neither blank nor comments, without sign and white space around them."""
    added = F.filter(_lines(diff), lambda x: x.startswith("+") & ~x.startswith("+++"))
    code = F.transform(added, lambda x: F.trim(F.substring(x, 2, (1 << 31) - 1)))
    return F.slice(F.filter(code, lambda x: (x != "") & ~x.rlike(_COMMENT_LINE)), 1, most)


def excerpt(diff: Column, most: int = 8) -> Column:
    """The first added or removed lines of a diff that aren't blank, with their signs; file headers don't count."""
    changed = F.filter(_lines(diff), lambda x: x.rlike("^[+-]") & ~x.rlike("^(?:\\+\\+\\+|---)") & ~x.rlike("^[+-][\\t-\\r ]*$"))
    return F.slice(changed, 1, most)


def near_changes(numbered: DataFrame, around: int = 3) -> DataFrame:
    """The lines of `numbered_diff` at most `around` lines from a change in their hunk, with `hidden`, how many lines were left out before each."""
    order = W.partitionBy("key").orderBy("position")
    changed = F.col("kind").isin("added", "removed").cast("int")
    near = F.max(changed).over(order.rowsBetween(-around, around)) == 1
    shown = numbered.where("kind <> 'header'").withColumn("__near", near).withColumn("__at", F.row_number().over(order)).where("__near")
    before = F.coalesce(F.lag("__at").over(order), F.lit(0))
    return shown.withColumn("hidden", F.col("__at") - before - 1).drop("__near", "__at")


def paired_changes(numbered: DataFrame) -> DataFrame:
    """(key, old_line, new_line, removed, added): removed lines with the added ones that replace them, in order within a run of changes; null where one side is longer."""
    order = W.partitionBy("key").orderBy("position")
    rows = numbered.withColumn("__opens", (F.col("kind").isin("same", "header") | (F.coalesce(F.lag("kind").over(order), F.lit("")) == "added") & (F.col("kind") == "removed")).cast("int"))
    rows = rows.withColumn("__run", F.sum("__opens").over(order)).where("kind in ('added', 'removed')")
    rows = rows.withColumn("__n", F.row_number().over(W.partitionBy("key", "__run", "kind").orderBy("position")))
    side = lambda k: F.max(F.when(F.col("kind") == k, F.struct(f"{'old' if k == 'removed' else 'new'}_line", "line")))
    got = rows.groupBy("key", "__run", "__n").agg(side("removed").alias("r"), side("added").alias("a"))
    return got.select("key", F.col("r.old_line").alias("old_line"), F.col("a.new_line").alias("new_line"), F.col("r.line").alias("removed"), F.col("a.line").alias("added"))

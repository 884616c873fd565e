"""Looking up chunks and symbols, and putting lists of them together.

Filters are plain predicates, so they reach the scan. A null in what is compared never matches; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import normalize_space


def by_id(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.where(F.col("chunk_id") == chunk_id)


def of_file(chunks: DataFrame, file_path: str) -> DataFrame:
    """The active chunks of a file, in the order of their lines."""
    return chunks.where((F.col("file_path") == file_path) & F.col("active")).orderBy("start_line", "end_line", "chunk_id")


def in_files(chunks: DataFrame, files: DataFrame, *keys: str) -> DataFrame:
    """The chunks of the files named; with keys, files are told by these columns."""
    return chunks.join(files.select(*(keys or ("file_path",))).distinct(), list(keys or ("file_path",)), "left_semi")


def named(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.where(F.col("symbol_name") == name)


def of_type(symbols: DataFrame, kind: str) -> DataFrame:
    return symbols.where(F.lower("symbol_type") == kind.lower())


def methods_of(symbols: DataFrame, parent: str) -> DataFrame:
    return symbols.where((F.col("parent_symbol") == parent) & (F.lower("symbol_type") == "method"))


def overlapping(symbols: DataFrame, ranges: DataFrame, *keys: str) -> DataFrame:
    """symbols whose lines meet a range (keys, first_line, last_line); each once.

    The join is on the keys, and ranges are made as few as possible before: neighbouring ones are one.
    """
    order = W.partitionBy(*keys).orderBy("first_line", "last_line")
    reached = F.max("last_line").over(order.rowsBetween(W.unboundedPreceding, -1))
    r = ranges.where("first_line <= last_line").select(*keys, "first_line", "last_line").distinct()
    r = r.withColumn("opens", F.when(reached.isNull() | (F.col("first_line") > reached + 1), 1).otherwise(0)).withColumn("island", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    r = r.groupBy(*keys, "island").agg(F.min("first_line").alias("__first"), F.max("last_line").alias("__last")).drop("island")
    met = (F.col("end_line") >= F.col("__first")) & (F.col("start_line") <= F.col("__last"))
    return symbols.join(r, list(keys)).where(met).drop("__first", "__last").distinct()


def distinct_drafts(drafts: DataFrame, *keys: str) -> DataFrame:
    """One of the drafts with equal keys, lines, symbol and content."""
    return drafts.dropDuplicates([*keys, "start_line", "end_line", "symbol_name", "content"])


def repeated_symbols(symbols: DataFrame, *keys: str) -> DataFrame:
    """(keys, symbol_name, start_line, symbol_type, n): symbols that a file has more than once."""
    return symbols.groupBy(*keys, "symbol_name", "start_line", "symbol_type").agg(F.count("*").alias("n")).where("n > 1")


def first_of_each(rows: DataFrame, keys: list[str], priority: str) -> DataFrame:
    """The row of the lowest priority for each key; ties go by the whole row. Combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct(priority, *(c for c in rest if c != priority))).alias("x")).select(*keys, "x.*").select(rows.columns)


def ordered_union(rows: DataFrame, by: list[str], order: str, *columns: str) -> DataFrame:
    """by and, for each array column, its items over all rows of the group, each once, in the order of their first mention.

    Items are reduced to their first place before they are gathered.
    """
    out = None
    for c in columns:
        each = rows.select(*by, F.col(order).alias("__o"), F.posexplode(c).alias("__i", "__x"))
        first = each.groupBy(*by, "__x").agg(F.min(F.struct("__o", "__i")).alias("__at"))
        got = first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__x"))), lambda x: x["__x"]).alias(c))
        out = got if out is None else out.join(got, by, "full_outer")
    return out


def described(symbol: Column) -> Column:
    """A symbol's name without its arguments, generic parameters and what qualifies it."""
    return F.element_at(F.split(normalize_space(F.regexp_replace(symbol, "[(<\\[].*$", "")), "\\.|::"), -1)

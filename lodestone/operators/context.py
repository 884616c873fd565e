"""From ranked hits to a context: the dependency channel, filter-then-fuse, the whole of a search, slices and their text."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import graph, retrieval

log = logging.getLogger(__name__)


def affected_files(edges: DataFrame, changed: DataFrame, depth: int = 2) -> DataFrame:
    """(query_id, file_path, is_changed) of the changed files (query_id, file_path) and those within `depth` edges, undirected; each once."""
    near = graph.within(edges, changed.select(F.col("file_path").alias("seed")).distinct(), depth)
    reached = changed.join(near, F.col("file_path") == F.col("seed")).select("query_id", F.col("node").alias("file_path"), F.lit(False).alias("is_changed"))
    own = changed.select("query_id", "file_path", F.lit(True).alias("is_changed"))
    return own.unionByName(reached).groupBy("query_id", "file_path").agg(F.max("is_changed").alias("is_changed"))


def dependency_files(edges: DataFrame, changed: DataFrame, depth: int = 2) -> DataFrame:
    """(query_id, file_path): the affected files that didn't change themselves; of a query without any, the changed ones."""
    files = affected_files(edges, changed, depth)
    others = files.where("not is_changed").select("query_id", "file_path")
    without = files.join(others, "query_id", "left_anti").select("query_id", "file_path")
    return others.unionByName(without)


def dependency_hits(edges: DataFrame, changed: DataFrame, chunks: DataFrame, depth: int = 2, k: int = 10) -> DataFrame:
    """(query_id, chunk_id, file_path, reason, score, rank): the first k active chunks of the affected files, by file and line; a chunk_id once."""
    files = affected_files(edges, changed, depth)
    named = changed.groupBy("query_id").agg(F.min("file_path").alias("seed"))
    hits = chunks.where("active").select("chunk_id", "file_path", "start_line").join(files, "file_path").groupBy("query_id", "chunk_id").agg(F.min(F.struct("file_path", "start_line", "is_changed")).alias("x"))
    order = W.partitionBy("query_id").orderBy("x.file_path", "x.start_line", "chunk_id")
    hits = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(named, "query_id")
    reason = F.when(F.col("x.is_changed"), "Changed file").otherwise(F.concat(F.lit("Dependency neighbor of "), F.col("seed")))
    return hits.select("query_id", "chunk_id", "x.file_path", reason.alias("reason"), F.lit(1.0).alias("score"), "rank")


def filtered(hits: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """The hits whose key is allowed, ranked anew without the gaps."""
    order = W.partitionBy("query_id").orderBy("rank", key)
    return hits.join(allowed.select(key).distinct(), key, "left_semi").withColumn("rank", F.row_number().over(order))


def retrieve(channels: dict[str, Callable[[], DataFrame]], allowed: DataFrame | None, key: str, k: int, pool: int = 40, rerank: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """(query_id, key, fused, score, channel, rank): each channel's hits are filtered, then fused, and the first `pool` of them reranked.

    A channel that can't be planned is left out, with a warning; so is a reranker that can't, and the fused order stays.
    """
    ready = {}
    for name, make in channels.items():
        try:
            hits = make()
            ready[name] = hits if allowed is None else filtered(hits, allowed, key)
        except Exception as e:  # one channel's failure leaves the others
            log.warning("channel %s is left out: %s", name, e)
    if not ready:
        raise ValueError("no channel is left")
    fused = retrieval.fuse(ready, key, max(k, pool) if rerank else k)
    if rerank is None:
        return fused
    try:
        return rerank(fused, k)
    except Exception as e:
        log.warning("not reranked: %s", e)
        return fused.where(F.col("rank") <= k)


def source_counts(fused: DataFrame) -> DataFrame:
    """(query_id, channel, n)."""
    return fused.groupBy("query_id", "channel").agg(F.count("*").alias("n"))


def _path(column: Column) -> Column:
    return F.lower(F.regexp_replace(F.translate(column, "\\", "/"), "^\\./", ""))


def file_slice(hits: DataFrame, targets: DataFrame, budget: int = 12_000) -> DataFrame:
    """For each target (target): its hits (chunk_id, file_path, reason, rank, n) within the budget of n; if no hit is of the file, those whose reason names it.

    A hit is of the file if its path is the target or ends with it after a slash.
    """
    t = targets.select("target", _path(F.col("target")).alias("__t")).distinct()
    h = hits.withColumn("__p", _path(F.col("file_path")))
    base = F.element_at(F.split("__t", "/"), -1)
    same = h.join(t, F.element_at(F.split("__p", "/"), -1) == base).where((F.col("__p") == F.col("__t")) | F.endswith("__p", F.concat(F.lit("/"), F.col("__t"))))
    without = t.join(same.select("target").distinct(), "target", "left_anti")
    # Reasons are few; the targets without a hit of their own look through them.
    reasons = h.select("reason").distinct().join(without, F.contains(F.lower("reason"), base)).select("reason", "target")
    named = h.join(reasons, "reason")
    columns = ["target", *hits.columns]
    return retrieval.within_budget(same.select(columns).unionByName(named.select(columns)), "target", "rank", "n", budget)


def module_slice(hits: DataFrame, modules: DataFrame, budget: int = 12_000) -> DataFrame:
    """For each module (module), a folder: the hits below it within the budget. A path meets its own folders only."""
    m = modules.select("module", F.regexp_replace(_path(F.col("module")), "/+$", "").alias("__m")).distinct()
    parts = F.split(_path(F.col("file_path")), "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    each = hits.where(_path(F.col("file_path")).contains("/")).withColumn("__m", F.explode(above))
    return retrieval.within_budget(each.join(m, "__m").drop("__m"), "module", "rank", "n", budget)


def context_text(hits: DataFrame, group: str) -> DataFrame:
    """(group, context): the hits' contents in order of rank, each under a line that says where it stands. A group is a result list."""
    head = F.format_string("[File: %s | Lines: %d-%d | Source: %s | Rank: %d]\n%s", "file_path", "start_line", "end_line", "channel", "rank", "content")
    return hits.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", head.alias("t")))), lambda x: x["t"]), "\n\n").alias("context"))

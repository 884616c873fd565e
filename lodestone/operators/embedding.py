"""Vectors for texts through a pluggable embedder, with a cache by content; scoring of candidates through a pluggable scorer."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.ids import cache_key
from lodestone.functions.text import search_terms
from lodestone.operators.chunks import blank


class Embedder(Protocol):
    name: str
    version: str
    dimension: int
    longest: int | None  # code points it reads of a text; None: all

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed feature hashing of words and word pairs, unit length; the same text always gives the same vector, without any model."""

    name, version, longest = "hashing", "2", None
    _WORD = re.compile(r"[A-Za-z0-9_]+")

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, t in zip(out, texts):
            words = [w.lower() for w in self._WORD.findall(t)]
            for w in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]:
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % self.dimension] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.where(n > 0, out / np.maximum(n, 1e-12), out)


def _embed(make: Callable[[], Embedder], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = make()
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                v = embedder.embed([t.strip()[: embedder.longest] for t in part.column(1).to_pylist()]).astype(np.float32)
                if v.shape[1] != embedder.dimension:
                    raise ValueError(f"{embedder.name} gave {v.shape[1]} components; {embedder.dimension} were announced")
                offsets = np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.ravel()))], names=["cache_key", "vector"])

    return run


def embedded(chunks: DataFrame, cache: DataFrame | None = None, make: Callable[[], Embedder] = HashingEmbedder, batch: int = 32) -> tuple[DataFrame, DataFrame]:
    """(chunk_id, vector, hit) of all chunks that aren't blank, and the cache (cache_key, vector) with what is new.

    Equal contents are embedded once; contents in the cache not at all. Only a text longer than the
    embedder's own `longest` input is embedded by its beginning; the default embedder has none and reads all.
    """
    e = make()
    rows = chunks.where(~blank(F.col("content"))).withColumn("cache_key", cache_key(F.col("content_hash"), e.name, e.version))
    if cache is None:
        cache = chunks.sparkSession.createDataFrame([], "cache_key string, vector array<float>")
    todo = rows.join(cache, "cache_key", "left_anti").groupBy("cache_key").agg(F.min("content").alias("content"))
    new = todo.mapInArrow(_embed(make, batch), "cache_key string, vector array<float>")
    known = cache.withColumn("hit", F.lit(True)).unionByName(new.withColumn("hit", F.lit(False)))
    return rows.select("chunk_id", "cache_key").join(known, "cache_key").select("chunk_id", "vector", "hit"), cache.unionByName(new)


def purged(cache: DataFrame, chunks: DataFrame, make: Callable[[], Embedder] = HashingEmbedder) -> DataFrame:
    """The cache without entries of other models, other versions or contents that no chunk has."""
    e = make()
    keys = chunks.select(cache_key(F.col("content_hash"), e.name, e.version).alias("cache_key"))
    return cache.join(keys, "cache_key", "left_semi")


def reranked(hits: DataFrame, k: int, pool: int = 40) -> DataFrame:
    """(query_id, key, score, rank) of the best k of the first `pool` hits (query_id, key, rank, question, content) by the share of
    the question's words that the content has; equal ones keep their order."""
    from pyspark.sql import Window as W

    words = F.array_distinct(search_terms(F.col("question")))
    share = F.size(F.array_intersect(words, search_terms(F.col("content")))) / F.greatest(F.lit(1), F.size(words))
    scored = hits.where(F.col("rank") <= pool).select("query_id", "key", F.col("rank").alias("old"), share.alias("score"))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "old")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("old")

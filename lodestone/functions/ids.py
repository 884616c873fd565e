"""Content-addressed identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(repository: Column, path: Column, symbol: Column, start: Column, end: Column, digest: Column) -> Column:
    """sha256 of the parts joined by ':'; a missing symbol stands for the module, other nulls for nothing between two colons."""
    parts = [repository, path, F.coalesce(symbol, F.lit("__module__")), start.cast("string"), end.cast("string"), digest]
    return F.sha2(F.concat_ws(":", *(F.coalesce(p, F.lit("")) for p in parts)), 256)


def cache_key(digest: Column, model: str, version: str) -> Column:
    return F.sha2(F.concat_ws(":", F.coalesce(digest, F.lit("")), F.lit(model), F.lit(version)), 256)


def combined(hashes: Column) -> Column:
    """One digest of an array of hashes, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(hashes), ""), 256)

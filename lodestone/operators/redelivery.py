"""Messages that were delivered more than once: one copy of each stays.

Identifiers go through three steps.
1. They are written once, in storage partitioned by time bucket. For each bucket and slice of the hash space a Bloom filter
   is built; both the filters and the identifiers that meet them are split by the same slices, so no task and no driver holds
   more than one slice.
2. Going through the buckets in order, an identifier that no earlier bucket's filter holds, and that is alone in its
   own, is new for certain. For the others the filters name the buckets that may hold it before.
3. Only those identifiers, read from only those buckets, are compared in full. The first copy of each is found by an
   aggregate that combines before the shuffle, so an identifier that a third of all messages carry is no hot group.

Defined results
- a null in any part of the key: the message is never a copy; a blank part counts like any other value
- keys are compared without letter case and outer white space
- the first is by received_at, then number, then position; a null received_at comes after all others
- rows equal in all of these are told apart by nothing: one such message counts as one
- empty tables give empty results; further columns are never read
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import written

_PROBES = 5
_NEVER = "9999-12-31 00:00:00"


def same_key(column: Column) -> Column:
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))


def push_ids(push_payloads: DataFrame) -> DataFrame:
    key = F.array(*(same_key(F.col(c)) for c in ("repository.full_name", "ref_name", "before_sha", "after_sha")))
    return push_payloads.select(F.lit("push").alias("kind"), key.alias("key"), "received_at", F.col("delivery_no").alias("no"), F.lit(0).alias("item"))


def commit_ids(push_payloads: DataFrame) -> DataFrame:
    each = push_payloads.select("received_at", "delivery_no", F.col("repository.full_name").alias("name"), F.posexplode("commits.id").alias("at", "id"))
    return each.select(F.lit("commit").alias("kind"), F.array(same_key(F.col("name")), same_key(F.col("id"))).alias("key"), "received_at", F.col("delivery_no").alias("no"), (F.col("at") + 1).alias("item"))


def workflow_ids(workflow_states: DataFrame) -> DataFrame:
    key = F.array(*(same_key(F.col(c)) for c in ("repository", "branch", "commit_sha", "status", "rag_stage")))
    return workflow_states.select(F.lit("workflow").alias("kind"), key.alias("key"), "received_at", F.col("state_no").alias("no"), F.lit(0).alias("item"))


def _bits(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The positions of each hash in a filter of size bits, one array for each probe."""
    h = hashes.view(np.uint64)
    a, b = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20), (h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(24) | np.uint64(1)
    for i in range(_PROBES):
        yield ((a + np.uint64(i) * b) % np.uint64(size)).astype(np.int64)


def _fill(hashes: np.ndarray, size: int) -> np.ndarray:
    bits = np.zeros(size, np.bool_)
    for at in _bits(hashes, size):
        bits[at] = True
    return np.packbits(bits)


def _holds(filter_: np.ndarray, hashes: np.ndarray, size: int) -> np.ndarray:
    found = np.ones(len(hashes), np.bool_)
    for at in _bits(hashes, size):
        found &= (filter_[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(np.bool_)
    return found


def _size(ids: int, bits_per_id: int) -> int:
    return 1 << max(12, (ids * bits_per_id).bit_length())


def _build(bits_per_id: int):
    """A filter for each bucket and slice, of a power of two of bits in proportion to its own identifiers."""

    def build(key: tuple, ids: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": [key[0]], "bucket": [key[1]], "filter": [_fill(ids["h"].to_numpy(np.int64), _size(len(ids), bits_per_id)).tobytes()]})

    return build


def _screen(bits_per_id: int):
    def screen(ids: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        filters = filters.sort_values("bucket")
        names, each = list(filters["bucket"]), [np.frombuffer(x, np.uint8) for x in filters["filter"]]
        # Positions are taken modulo a power of two, so a filter repeated to a greater size holds what it held.
        size = max([_size(len(ids), bits_per_id), *(8 * len(x) for x in each)])
        before, hits, buckets = np.zeros(size // 8, np.uint8), [], []
        groups = {b: g for b, g in ids.groupby("bucket")}
        for k, name in enumerate(names):
            here = groups[name]
            h = here["h"].to_numpy(np.int64)
            twice = h[here["n"].to_numpy() > 1]
            hits.append(twice)
            buckets.append(np.full(len(twice), k))
            maybe = h[_holds(before, h, size)]
            found = np.zeros(len(maybe), np.bool_)
            for j in range(k if len(maybe) else 0):
                at = _holds(each[j], maybe, 8 * len(each[j]))
                found |= at
                hits.append(maybe[at])
                buckets.append(np.full(int(at.sum()), j))
            hits.append(maybe[found])
            buckets.append(np.full(int(found.sum()), k))
            before = before | np.tile(each[k], size // (8 * len(each[k])))
        h, b = np.concatenate(hits or [np.zeros(0, np.int64)]), np.concatenate(buckets or [np.zeros(0, np.int64)])
        return pd.DataFrame({"h": h.astype(np.int64), "bucket": [names[i] for i in b.astype(np.int64)]}).drop_duplicates()

    return screen


def possible_repeats(stored: DataFrame, ids_per_slice: int = 200_000, bits_per_id: int = 12) -> DataFrame:
    """(h, bucket): identifiers that may have copies, with every bucket that may hold one. Nothing with a copy is missing."""
    small = stored.groupBy("h", "bucket").agg(F.count("*").alias("n"))
    total = stored.count()
    slices = max(8, ceil(total / ids_per_slice))
    small = small.withColumn("slice", F.pmod(F.xxhash64("h"), F.lit(slices)).cast("int"))
    filters = small.groupBy("slice", "bucket").applyInPandas(_build(bits_per_id), "slice int, bucket string, filter binary")
    return small.groupBy("slice").cogroup(filters.groupBy("slice")).applyInPandas(_screen(bits_per_id), "h long, bucket string")


def repeats(ids: DataFrame, bucket: str = "week") -> DataFrame:
    """(kind, no, item) of every copy but the first; ids has kind, key array<string>, received_at, no, item."""
    when = F.coalesce("received_at", F.lit(_NEVER).cast("timestamp_ntz").cast(dict(ids.dtypes)["received_at"]))
    ids = ids.where(~F.exists("key", lambda x: x.isNull())).withColumns(
        {
            "received_at": when,
            "h": F.xxhash64("kind", "key"),
            "bucket": F.date_format(F.date_trunc(bucket, when), "yyyy-MM-dd"),
        }
    )
    stored = written(ids, "identifiers", ["bucket"])
    stored = stored.select("kind", "key", "received_at", "no", "item", "h", "bucket")
    suspects = written(possible_repeats(stored), "suspects")
    compared = stored.join(suspects, ["bucket", "h"], "left_semi")
    order = F.struct("received_at", "no", "item")
    firsts = compared.groupBy("h", "kind", "key").agg(F.min(order).alias("first"))
    return compared.join(firsts, ["h", "kind", "key"]).where(order != F.col("first")).select("kind", "no", "item").distinct()


def delivery_repeats(push_payloads: DataFrame, workflow_states: DataFrame, bucket: str = "week") -> DataFrame:
    """(record_kind, record_no, item_no) of the pushes, commits and workflow states to drop."""
    ids = push_ids(push_payloads).unionByName(commit_ids(push_payloads)).unionByName(workflow_ids(workflow_states))
    return repeats(ids, bucket).select(F.col("kind").alias("record_kind"), F.col("no").cast("long").alias("record_no"), F.col("item").cast("int").alias("item_no"))

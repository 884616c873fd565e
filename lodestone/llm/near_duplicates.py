"""Texts that share most of their word shingles, across a collection of any size.

1. A text's shingles are the distinct runs of `words` consecutive words, hashed to 64 bits by one function. Texts with the
   same set of shingles form a class; from here on only classes are compared, each by one of its texts.
2. A class keeps the k smallest hashes, its sketch. A value in the sketch of the union of two sets is in both sketches if
   and only if both sets have it, so of two sets of similarity t about t k such values are shared.
3. Inverted lists of retained values give candidates. As at least `least_shared` values are shared (what that loses is in
   `lost_pairs`), each class may leave out its `least_shared - 1` most frequent ones: rarer shared ones remain. The union's sketch estimates
   the similarity of each candidate; those far below the threshold go.
4. Values that are still in more than `frequent` classes make no candidates, so text that many classes have in common doesn't make
   all of them candidates of one another. The classes that have such values are compared with each other on their whole sets, exactly:
   two sets of similarity t or more share one of the rarest 1 - t of the larger and of the rarest 1 - 2t/(1+t) of the smaller set
   (each and one more), rarity being the same for all. Lists of these are long only where that much of the sets is alike.
5. All candidates are verified on their whole sets. Only classes of some candidate or with frequent values are shingled again;
   a filter of bits in proportion to their number tells the scan which these are.

Defined results
- a word is a longest run of a-z, 0-9 and _ in the lower-cased text; fewer than `words` words: no shingle, never similar
- similarity is the number of common shingles over the number in either; equal sets of shingles have similarity 1
- a key counts once; its rows are taken to have equal texts (of different ones, that with the greatest hash counts)
- null texts and keys are dropped; texts of any length are shingled whole; further columns are never read
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import written

WORDS, THRESHOLD, SKETCH, LEAST_SHARED, FREQUENT = 3, 0.6, 24, 5, 8
#: The filter has eight bits a class at least, 4 MB at least and 128 MB at most; beyond 10^8 classes it lets more through, and all is checked by a join.
_LEAST_BITS, _MOST_BITS = 25, 30
_WORD = re.compile("[a-z0-9_]+")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def lost_pairs(similarity: float, sketch: int = SKETCH, least_shared: int = LEAST_SHARED) -> float:
    """The share of pairs of this similarity whose sketches have fewer than least_shared values in common."""
    return sum(comb(sketch, i) * similarity**i * (1 - similarity) ** (sketch - i) for i in range(least_shared))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Words()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    found = _WORD.findall(text.lower()) if text else []
    if len(found) < words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    n = len(h) - words + 1
    x = np.zeros(n, np.uint64)
    for i in range(words):
        x = (x ^ h[i : i + n]) * _M1
        x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return np.unique((x * _M3).view(np.int64))


def _class(values: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(values.tobytes()) - (1 << 63)


def _sketches(words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ones, sizes, parts = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = shingles(text, words)
                if len(v):
                    keys.append(key)
                    ones.append(_class(v))
                    sizes.append(len(v))
                    parts.append(v[:k])
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ones, pa.int64()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["key", "c", "n", "sketch"])

    return run


def _holds(bits: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each class."""
    size = len(bits) << 6
    found = np.ones(len(c), np.bool_)
    for p in (c & (size - 1), c >> 31 & (size - 1)):
        found &= (bits[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(np.bool_)
    return found


def _filter(classes: DataFrame) -> np.ndarray:
    """A Bloom filter of the classes c; made by bit_or, so that only its words move."""
    width = min(_MOST_BITS, max(_LEAST_BITS, (8 * classes.count()).bit_length()))
    mask = (1 << width) - 1
    at = F.explode(F.array(F.col("c").bitwiseAND(F.lit(mask)), F.shiftright("c", 31).bitwiseAND(F.lit(mask))))
    rows = classes.select(at.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (width - 6), np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def _kept(bits):
    """The classes that the filter lets pass, before their sketches are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_holds(bits.value, batch.column(0).to_numpy())))

    return run


def _pairs_of(lists: DataFrame) -> DataFrame:
    """(a, b), a < b, of (key, c) whose lists are short: each list is gathered once and paired where it stands."""
    gathered = lists.groupBy("key").agg(F.array_sort(F.collect_list("c")).alias("l")).where(F.size("l") > 1)
    a = gathered.select("l", F.posexplode("l").alias("i", "a"))
    return a.select("a", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("b"))


def _ordered(classes: DataFrame, threshold: float, least_shared: int) -> DataFrame:
    """(c, f, v): the retained values of each class that some other class has too, but for as many of the most frequent as it may leave out."""
    each = classes.select("c", "n", F.explode("sketch").alias("v"))
    counts = each.groupBy("v").agg(F.count("*").alias("f")).where("f > 1")
    need = F.least(F.lit(least_shared), F.ceil(F.col("n") * threshold).cast("int"))
    # Rarest first; values of one class only come before all of them and need no room.
    order = each.join(counts, "v").groupBy("c", "n").agg(F.array_sort(F.collect_list(F.struct("f", "v"))).alias("o"))
    return order.select("c", F.explode(F.slice("o", 1, F.greatest(F.lit(0), F.size("o") - need + 1))).alias("x")).select("c", "x.f", "x.v")


def _on_whole_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: every pair of (c, whole) that may be similar, by the prefixes of the sets in order of rarity."""
    each = sets.select("c", F.size("whole").alias("n"), F.explode("whole").alias("v"))
    counts = each.groupBy("v").agg(F.count("*").alias("f")).where("f > 1")
    order = each.join(counts, "v").groupBy("c", "n").agg(F.array_sort(F.collect_list(F.struct("f", "v"))).alias("o"))
    n, alone = F.col("n"), F.col("n") - F.size("o")  # values of one class only are the rarest

    def prefix(share: float) -> DataFrame:
        length = n - F.ceil(n * share - 1e-6).cast("int") + 1 - alone
        return order.select("c", "n", F.explode(F.slice("o", 1, F.greatest(F.lit(0), length))).alias("x")).select("c", "n", F.col("x.v").alias("v"))

    larger, smaller = prefix(threshold).alias("l"), prefix(2 * threshold / (1 + threshold)).alias("s")
    fits = (F.col("s.n") >= F.col("l.n") * threshold - 1e-6) & ((F.col("s.n") < F.col("l.n")) | ((F.col("s.n") == F.col("l.n")) & (F.col("s.c") < F.col("l.c"))))
    pairs = larger.join(smaller, F.col("l.v") == F.col("s.v")).where(fits)
    return pairs.select(F.least("l.c", "s.c").alias("a"), F.greatest("l.c", "s.c").alias("b")).distinct()


def similar_classes(chunks: DataFrame, key: str = "chunk_id", text: str = "content", words: int = WORDS, threshold: float = THRESHOLD, sketch: int = SKETCH, least_shared: int = LEAST_SHARED, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """Members (key, c) and verified pairs of classes (a, b, similarity), a < b."""
    spark = chunks.sparkSession
    rows = chunks.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    shingled = rows.select(F.col(key).cast("string"), text).mapInArrow(_sketches(words, sketch), "key string, c long, n int, sketch array<long>")
    # Shingling twice costs less than moving the sketches once for their keys and once more for their classes.
    members = written(shingled.groupBy("key").agg(F.max("c").alias("c")), "members")
    classes = written(shingled.groupBy("c").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    values = written(_ordered(classes, threshold, least_shared), "values")
    pairs = written(_pairs_of(values.where(F.col("f") <= frequent).select("c", F.col("v").alias("key"))).distinct(), "candidates")
    crowded = written(values.where(F.col("f") > frequent).select("c").distinct(), "crowded")
    bits = spark.sparkContext.broadcast(_filter(pairs.select(F.explode(F.array("a", "b")).alias("c"))))
    sketched = classes.mapInArrow(_kept(bits), "c long, n int, sketch array<long>")
    side = lambda x: sketched.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").where("na > 0").join(side("b"), "b").where(F.least("na", "nb") >= F.greatest("na", "nb") * threshold)
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, sketch)
    shared = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    need = F.when(F.size(union) < sketch, F.ceil(F.size(union) * threshold).cast("int")).otherwise(F.lit(least_shared))
    near = written(both.where(shared >= need).select("a", "b"), "near")
    wanted = written(near.select(F.explode(F.array("a", "b")).alias("c")).unionByName(crowded).distinct(), "wanted")
    bits = spark.sparkContext.broadcast(_filter(wanted))
    texts = rows.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(_again(words, bits), "c long, whole array<long>")
    # Copies are put together before the shuffle, so a class that a third of all rows have is no hot key.
    sets = written(texts.groupBy("c").agg(F.first("whole").alias("whole")).join(wanted, "c", "left_semi"), "sets")
    exact = _on_whole_sets(sets.join(crowded, "c", "left_semi"), threshold)
    each = near.unionByName(exact).distinct()
    one = each.join(sets.select(F.col("c").alias("a"), F.col("whole").alias("wa")), "a")
    two = one.join(sets.select(F.col("c").alias("b"), F.col("whole").alias("wb")), "b")
    common = two.select("a", "b", F.size(F.array_intersect("wa", "wb")).alias("x"), F.size("wa").alias("na"), F.size("wb").alias("nb"))
    similarity = F.col("x") / (F.col("na") + F.col("nb") - F.col("x"))
    return members, written(common.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold), "pairs")


def _again(words: int, bits):
    """The whole sets of the texts whose class is in the filter; the class is known only after shingling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [v for text in batch.column(1).to_pylist() if len(v := shingles(text, words))]
            every = np.fromiter(map(_class, each), np.int64, len(each))
            keep = _holds(bits.value, every)
            ones, parts = every[keep], [v for v, k in zip(each, keep) if k]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ones, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["c", "whole"])

    return run


def near_duplicates(chunks: DataFrame, **options) -> DataFrame:
    """(chunk_id, class_id, copies, links): each chunk with shingles, how many others have its set, and how many classes are similar to its own.

    Copies aren't expanded into pairs here, so a class that a third of all chunks share costs no more than its members.
    """
    members, pairs = similar_classes(chunks, **options)
    links = pairs.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("links"))
    sizes = members.groupBy("c").agg((F.count("*") - 1).alias("copies"))
    return members.join(sizes.join(links, "c", "left"), "c").select(F.col("key").alias("chunk_id"), F.col("c").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicate_pairs(chunks: DataFrame, **options) -> DataFrame:
    """(chunk_id_a, chunk_id_b), a < b: every pair of chunks at or over the threshold, copies included."""
    members, pairs = similar_classes(chunks, **options)
    m = members.select(F.col("c").alias("a"), F.col("key").alias("x"))
    n = members.select(F.col("c").alias("b"), F.col("key").alias("y"))
    across = pairs.select("a", "b").join(m, "a").join(n, "b").select(F.least("x", "y").alias("chunk_id_a"), F.greatest("x", "y").alias("chunk_id_b"))
    several = members.groupBy("c").count().where("count > 1").select("c")
    twins = members.join(several, "c")
    within = twins.select("c", F.col("key").alias("chunk_id_a")).join(twins.select("c", F.col("key").alias("chunk_id_b")), "c").where("chunk_id_a < chunk_id_b").drop("c")
    return across.unionByName(within)

"""Documents of several sources mixed so that each source makes up its share of all tokens.

1. Every document's length in tokens is counted once. Within its source it gets a place in a pseudorandom order and, by prefix
   sums over hash ranges (as many as keep to about `PER_RANGE` documents each), an offset; so each source is a stream of tokens, cut into blocks of `block` tokens (the
   last one may be shorter). A block names its pieces: document, first token, number of tokens.
2. The size of the mixture is the largest at which no source with documents needs more than max_repeats passes. Shares of sources
   without documents go to the others in proportion. Blocks for each source follow by largest remainders.
3. Output shards draw how many blocks of each source they get from a multinomial law conditioned on those totals, so
   shards differ as in free sampling and the totals, and with them the caps, hold exactly. The totals are split over `GROUPS`
   groups of shards first, on the driver, and within each group over its shards, in the tasks.
4. The slots of a source, numbered through all shards, are mapped to its blocks by one pseudorandom permutation of the block
   numbers for each pass, so no block comes a second time before all have come once.
5. Slots and blocks are joined by source and block number.

Defined results
- sources are compared without letter case, outer white space and the difference of - and _; a null or blank source, and
  one without a target, takes no part
- a target without documents, or whose documents have no tokens: no blocks, reported with actual share 0
- targets that name one source twice: their shares add up, the larger cap holds; null or negative shares count as 0, a null cap as 1
- documents without tokens are in no block; rows with equal doc_id are documents of their own
- no documents or no positive share: an empty mixture; ties in the order are broken by doc_id and the tokens
- the same input, seed and sizes give the same mixture, whatever the partitioning
"""

from __future__ import annotations

from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.tokens import VOCABULARY, encoder
from lodestone.session import written

BLOCK, SHARD_BLOCKS, SEED, RANGES, PER_RANGE, GROUPS = 256, 1024, 11, 64, 500_000, 512
#: Beyond so many blocks the exact draw of a group's share gives way to the normal law with the same mean and variance.
_EXACT = 900_000_000

MIXTURE = "shard int, slot int, source string, pass int, block_no long, n_tokens int, pieces array<struct<doc_id:long,first:int,count:int>>, ids array<int>"


def same_source(column: Column) -> Column:
    name = F.translate(F.lower(F.regexp_replace(column, r"^\s+|\s+$", "")), "-", "_")
    return F.when(name != "", name)


def _tokenized(vocabulary: str):
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        e = encoder(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                ids = e.encode(part.column(2))
                packed = ids.values.to_numpy().astype(_width(vocabulary))
                offsets = ids.offsets.to_numpy().astype(np.int32) * packed.itemsize
                packed = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pc.cast(pc.list_value_length(ids), pa.int32()), packed], names=["doc_id", "source", "n", "ids"])

    return run


def _width(vocabulary: str):
    """Ids travel in two bytes where the vocabulary allows."""
    return np.uint16 if encoder(vocabulary).bpe.n_vocab <= 1 << 16 else np.int32


def _unpacked(vocabulary: str):
    import pyarrow as pa

    def run(batches):
        width = _width(vocabulary)
        for batch in batches:
            x = batch.column(6)
            items = x.flatten()
            data = b"".join(items.field("ids").to_pylist())
            ids = np.frombuffer(data, width).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(batch.column(5).to_numpy())]).astype(np.int32)
            pieces = pa.StructArray.from_arrays([items.field(f) for f in ("doc_id", "first", "count")], names=["doc_id", "first", "count"])
            at = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(x).to_numpy())]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.ListArray.from_arrays(pa.array(at), pieces), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=["shard", "slot", "source", "pass", "block_no", "n_tokens", "pieces", "ids"])

    return run


def offsets(docs: DataFrame, seed: int = SEED, ranges: int = RANGES) -> DataFrame:
    """docs (row, doc_id, source, n, t) with the offset of each in its source's stream: prefix sums within hash ranges plus those of the ranges before."""
    h = F.xxhash64("doc_id", F.lit(seed))
    ranged = docs.withColumns({"h": h, "range": F.pmod(F.shiftright(h, 40), F.lit(ranges)).cast("int")})
    sums = ranged.groupBy("source", "range").agg(F.sum("n").alias("in_range"))
    before = sums.withColumn("before", F.sum("in_range").over(W.partitionBy("source").orderBy("range")) - F.col("in_range")).drop("in_range")
    inside = F.sum("n").over(W.partitionBy("source", "range").orderBy("h", "doc_id", "t").rowsBetween(W.unboundedPreceding, -1))
    return ranged.withColumn("inside", F.coalesce(inside, F.lit(0))).join(before, ["source", "range"]).withColumn("offset", F.col("inside") + F.col("before")).drop("h", "t", "range", "inside", "before")


def plan(sizes: dict[str, int], targets: dict[str, tuple[float, int]], block: int) -> dict[str, dict]:
    """For each target: tokens, blocks, share among the sources that have documents, and the number of slots."""
    out = {s: {"tokens": sizes.get(s, 0), "blocks": -(-sizes.get(s, 0) // block), "target": share, "repeats": cap, "share": 0.0, "slots": 0} for s, (share, cap) in targets.items()}
    usable = [s for s, x in out.items() if x["tokens"] and x["target"] > 0 and x["repeats"] > 0]
    total = sum(out[s]["target"] for s in usable)
    if not usable:
        return out
    for s in usable:
        out[s]["share"] = out[s]["target"] / total
    size = min(out[s]["tokens"] * out[s]["repeats"] / out[s]["share"] for s in usable)
    # Blocks at the end of a source may be short, so slots are counted in what a source's blocks hold on average.
    exact = {s: min(size * out[s]["share"] / (out[s]["tokens"] / out[s]["blocks"]), out[s]["blocks"] * out[s]["repeats"]) for s in usable}
    for s in usable:
        out[s]["slots"] = floor(exact[s] + 1e-9)
    left = round(sum(exact.values())) - sum(x["slots"] for x in out.values())
    for s in sorted(usable, key=lambda s: (out[s]["slots"] - exact[s], s))[: max(0, left)]:
        out[s]["slots"] += out[s]["slots"] < out[s]["blocks"] * out[s]["repeats"]
    return out


def _share(rng: np.random.Generator, mine: int, others: int, n: int) -> int:
    """How many of n blocks, drawn from mine + others, are mine."""
    if mine + others <= _EXACT:
        return int(rng.hypergeometric(mine, others, n)) if n and mine else 0
    total = mine + others
    mean = n * mine / total
    spread = (mean * others / total * (total - n) / max(1, total - 1)) ** 0.5
    return min(mine, n, max(0, n - others, round(rng.normal(mean, spread))))


def _split(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """Counts of each source among n blocks drawn from left: a multinomial draw given the totals."""
    out, rest, total = np.zeros(len(left), np.int64), n, int(left.sum())
    for i, mine in enumerate(left.tolist()):
        total -= mine
        out[i] = _share(rng, mine, total, rest) if total else min(mine, rest)
        rest -= int(out[i])
    return out


def grouped(slots: dict[str, int], shard_blocks: int, seed: int, groups: int = GROUPS) -> list[tuple[int, int, list[int], list[int]]]:
    """(group, first shard, first slot number of each source, number of slots of each) over the sources in order of name."""
    rng, names = np.random.default_rng(seed), sorted(slots)
    left = np.array([slots[s] for s in names], np.int64)
    shards = -(-int(left.sum()) // shard_blocks)
    per = max(1, -(-shards // groups))
    out, at = [], np.zeros(len(names), np.int64)
    for g in range(-(-shards // per)):
        n = min(per * shard_blocks, int(left.sum()))
        counts = _split(rng, left, n)
        out.append((g, g * per, at.tolist(), counts.tolist()))
        at, left = at + counts, left - counts
    return out


def _drawn(shard_blocks: int, seed: int):
    """Each group's shards: (shard, at, first, count) for each source, `at` being its place in the order of names."""

    def run(batches):
        for p in batches:
            for group, shard, at, left in zip(p["group"].tolist(), p["shard"].tolist(), p["first"], p["count"]):
                rng = np.random.default_rng([seed, group])
                at, left, parts = np.array(at, np.int64), np.array(left, np.int64), []
                while left.sum():
                    counts = _split(rng, left, min(shard_blocks, int(left.sum())))
                    has = np.flatnonzero(counts)
                    parts.append((np.full(len(has), shard), has, at[has], counts[has]))
                    at, left, shard = at + counts, left - counts, shard + 1
                    if len(parts) >= 5000:
                        yield _rows(parts)
                        parts = []
                if parts:
                    yield _rows(parts)

    return run


def _rows(parts: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("shard", "at", "first", "count"), (np.concatenate(x) for x in zip(*parts)))))


def draw(spark, slots: dict[str, int], shard_blocks: int, seed: int, groups: int = GROUPS) -> DataFrame:
    """(shard, at, first, count): the slots of each source in each shard; the driver makes `groups` rows at most."""
    rows = grouped(slots, shard_blocks, seed, groups)
    frame = spark.createDataFrame(rows, "group int, shard long, first array<long>, count array<long>")
    if len(rows) > 1:
        frame = frame.repartition(min(len(rows), 64), "group")
    return frame.mapInPandas(_drawn(shard_blocks, seed), "shard int, at int, first long, count long")


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """index -> its place under a pseudorandom permutation of 0..size-1, chosen by key: a four-round Feistel network, walked until inside."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2).astype(np.uint64))
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, open_ = index.astype(np.uint64), np.ones(len(index), np.bool_)
    key = key.astype(np.uint64)
    while open_.any():
        left, right = x >> half, x & mask
        for r in range(4):
            m = (right + key + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            m = (m ^ (m >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((m >> np.uint64(29)) & mask)
        x = np.where(open_, left << half | right, x)
        open_ = x >= size.astype(np.uint64)
    return x.astype(np.int64)


def _blocks_of(batches):
    for p in batches:
        n, size, key = p["number"].to_numpy(np.int64), p["blocks"].to_numpy(np.int64), p["key"].to_numpy(np.int64)
        turn = n // size
        yield pd.DataFrame({"shard": p["shard"], "slot": p["slot"], "source": p["source"], "pass": turn + 1, "block_no": permuted(n % size, size, key * 1_000_003 + turn)})


def mixture(documents: DataFrame, targets: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mixture, a row for each slot, and the report, a row for each target."""
    spark = documents.sparkSession
    wanted: dict[str, tuple[float, int]] = {}
    for r in targets.select(same_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").collect():
        old = wanted.get(r.source, (0.0, 0))
        wanted[r.source] = old[0] + max(0.0, r.target_share or 0.0), max(old[1], 1 if r.max_repeats is None else r.max_repeats)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), same_source(F.col("source")).alias("source"), "text").where(F.col("source").isin(list(wanted)) if wanted else F.lit(False))
    tokens = written(rows.mapInArrow(_tokenized(vocabulary), "doc_id long, source string, n int, ids binary").where("n > 0").withColumns({"t": F.xxhash64("ids"), "row": F.monotonically_increasing_id()}), "tokens")
    found = tokens.groupBy("source").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).collect()
    sizes = {r.source: r.n for r in found}
    ranges = max(RANGES, -(-max((r.docs for r in found), default=0) // PER_RANGE))
    plans = plan(sizes, wanted, block)
    facts = spark.createDataFrame([(i, s, plans[s]["blocks"], abs(hash_of(s, seed))) for i, s in enumerate(sorted(plans))], "at int, source string, blocks long, key long")
    counts = draw(spark, {s: x["slots"] for s, x in plans.items()}, shard_blocks, seed).join(F.broadcast(facts), "at")  # a row for each target
    each = counts.select("shard", "source", "blocks", "key", F.explode(F.expr("sequence(first, first + count - 1)")).alias("number"))
    order = W.partitionBy("shard").orderBy(F.xxhash64("shard", "source", "number", F.lit(seed)), "source", "number")
    slots = each.withColumn("slot", (F.row_number().over(order) - 1).cast("int"))
    slots = slots.mapInPandas(_blocks_of, "shard int, slot int, source string, pass int, block_no long")
    placed = offsets(tokens.select("row", "doc_id", "source", "n", "t"), seed, ranges)
    end = F.col("offset") + F.col("n")
    cuts = placed.select("row", "doc_id", "source", "offset", end.alias("end"), F.explode(F.expr(f"sequence(floor(offset / {block}), floor((offset + n - 1) / {block}))")).alias("block_no"))
    start = F.greatest("offset", F.col("block_no") * block)
    stop = F.least("end", (F.col("block_no") + 1) * block)
    pieces = cuts.select("row", "doc_id", "source", "block_no", (start - F.col("block_no") * block).cast("int").alias("at"), (start - F.col("offset")).cast("int").alias("first"), (stop - start).cast("int").alias("count"))
    size_of = np.dtype(_width(vocabulary)).itemsize
    used = slots.join(pieces, ["source", "block_no"])
    filled = used.join(tokens.select("row", "ids"), "row").withColumn("ids", F.substring("ids", F.col("first") * size_of + 1, F.col("count") * size_of))
    got = filled.groupBy("shard", "slot").agg(F.first("source").alias("source"), F.first("pass").alias("pass"), F.first("block_no").alias("block_no"), F.sum("count").cast("int").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("at", "doc_id", "first", "count", "ids"))).alias("x"))
    mixed = got.select("shard", "slot", "source", "pass", "block_no", "n_tokens", "x").mapInArrow(_unpacked(vocabulary), MIXTURE)
    # What each source gives follows from its slots and blocks; the tokens of a slot needn't be read again for it.
    lengths = slots.groupBy("source", "block_no").agg(F.count("*").alias("times"))
    size = spark.createDataFrame([(s, x["tokens"]) for s, x in plans.items()], "source string, tokens long")
    held = lengths.join(F.broadcast(size), "source").withColumn("held", F.least(F.lit(block), F.col("tokens") - F.col("block_no") * block))
    actual = held.groupBy("source").agg(F.sum(F.col("held") * F.col("times")).alias("mixed_tokens"), F.max("times").alias("most_repeats"))
    base = spark.createDataFrame([(s, float(x["target"]), float(x["share"]), x["repeats"], x["tokens"]) for s, x in plans.items()], "source string, target_share double, share_of_available double, max_repeats int, source_tokens long")
    report = base.join(actual, "source", "left").na.fill(0, ["mixed_tokens", "most_repeats"])
    whole = F.sum("mixed_tokens").over(W.partitionBy(F.lit(1)))
    return mixed, report.withColumn("actual_share", F.coalesce(F.try_divide("mixed_tokens", whole), F.lit(0.0)))


def hash_of(name: str, seed: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(name, seed) >> 2

"""The k most similar vectors of every vector, from navigable small-world graphs over shards.

1. Chunks with equal vectors form a class; only distinct vectors are indexed and searched, each once.
2. A tree of centroids divides the space: its first level is fitted on a bounded sample on the driver; leaves that hold more than twice
   `shard_size` vectors are divided again, each on a bounded sample of its own in a task, until none is too large. A leaf is a shard.
   What can't be divided by centroids any more is divided by hash and searched in all its parts.
3. Every vector is indexed in the shard it reaches by the nearest centroids. Each shard's graph is built in one task and stored as
   flat arrays in one row (`graph_index`).
4. A vector is searched in the shards whose centroid is at most `margin` less similar than its nearest one, the `PROBED` nearest of them at
   most; it goes down the tree and meets the centroids of a few nodes only, whatever the number of shards. The queries
   of a shard that many ask are split into parts, each with a copy of the graph. The shards' results are merged by similarity.
5. Classes are opened again: copies of a chunk's own vector come first, then the members of the similar classes.

Defined results
- usable is a vector of `dimension` finite components, not all zero; others neither have nor are neighbours
- a chunk_id counts once, with the vector of its newest usable row; rows without chunk_id are dropped
- vectors of any length count by direction; equal vectors and ties come in order of chunk_id
- fewer than k others: all of them; none or one: no pair; further columns are never read
- vectors are told apart by a 64-bit hash of their components
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.graph_index import Graph, build
from lodestone.session import partitions, written

K, DIMENSION = 5, 64
SHARD_SIZE, MARGIN, PROBED, PER_SHARD_SAMPLE = 16_000, 0.13, 12, 256
#: Centroids of a node of the tree, levels of it, queries in a part (in shard sizes), and shards at most: beyond 2 G vectors shards grow instead,
#: so that the broadcast tree keeps to 2^17 centroids (33 MB).
BRANCHES, LEVELS, PART, MOST_SHARDS = 64, 6, 4, 1 << 17
LINKS, BUILD_WIDTH, SEARCH_WIDTH = 12, 32, 24

_INDEX = "shard int, piece int, n int, vids binary, vectors binary, base binary, upper binary"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def usable(vector: Column, dimension: int = DIMENSION) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    return F.coalesce((F.size(vector) == dimension) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(column: pa.Array) -> np.ndarray:
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(x), -1) if len(x) else flat.reshape(0, 1)
    x = x / np.maximum(np.abs(x).max(1, keepdims=True, initial=0), 1e-300)
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).astype(np.float32)


def fit_centroids(sample: np.ndarray, shards: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Spherical k-means; a centroid that loses all of its vectors starts again at a random one."""
    rng = np.random.default_rng(seed)
    shards = max(1, min(shards, len(sample)))
    c = sample[rng.choice(len(sample), shards, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(sample), 4096)])
        new = np.zeros_like(c)
        np.add.at(new, near, sample)
        size = np.linalg.norm(new, axis=1, keepdims=True)
        lost = size[:, 0] < 1e-9
        new[lost] = sample[rng.choice(len(sample), int(lost.sum()))]
        c = np.where(lost[:, None], new, new / np.maximum(size, 1e-9))
    return c.astype(np.float32)


class Tree:
    """Nodes of centroids; each centroid leads to another node or is a shard.

    nodes: centroids of each node; targets: for each of them the number of a node (>= 0) or, as -1 - number, of a shard.
    pieces: in how many parts by hash each shard's vectors are; parts: in how many its queries.
    """

    def __init__(self, centroids: np.ndarray):
        self.nodes, self.targets = [centroids], [-1 - np.arange(len(centroids))]
        self.shards = len(centroids)
        self.pieces, self.parts = np.ones(self.shards, np.int64), np.ones(self.shards, np.int64)

    def divide(self, shard: int, centroids: np.ndarray) -> None:
        """Shard becomes a node; its first child keeps the number."""
        new = np.concatenate([[shard], np.arange(self.shards, self.shards + len(centroids) - 1)])
        for t in self.targets:
            t[t == -1 - shard] = len(self.nodes)
        self.nodes.append(centroids)
        self.targets.append(-1 - new)
        self.shards += len(centroids) - 1
        self.pieces, self.parts = np.ones(self.shards, np.int64), np.ones(self.shards, np.int64)

    def route(self, unit: np.ndarray, margin: float, probed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, home): the shards to search for each vector, one of which is its home."""
        n = len(unit)
        best = np.full(n, -3.0, np.float32)
        found, todo = [], [(0, np.arange(n))]
        home, home_sim = np.full(n, -1), np.full(n, -3.0, np.float32)
        first = {0: np.ones(n, np.bool_)}  # whether the row's way to the node took the nearest centroid each time
        while todo:
            node, rows = todo.pop()
            own = first[node][rows]
            s = unit[rows] @ self.nodes[node].T
            nearest = s.argmax(1)
            for i, target in enumerate(self.targets[node].tolist()):
                near = s[:, i] >= s.max(1) - margin
                if len(self.nodes[node]) > probed:
                    near &= s[:, i] >= -np.partition(-s, probed - 1, 1)[:, probed - 1]
                here, mine = rows[near], own[near] & (nearest[near] == i)
                if not len(here):
                    continue
                if target >= 0:
                    first[target] = np.zeros(n, np.bool_)
                    first[target][here[mine]] = True
                    todo.append((target, here))
                else:
                    found.append((here, np.full(len(here), -1 - target), s[near, i]))
                    best[here] = np.maximum(best[here], s[near, i])
                    home[here[mine]] = -1 - target
        row, shard, sim = (np.concatenate(x) for x in zip(*found))
        keep = (sim >= best[row] - margin) | (home[row] == shard)
        row, shard, sim = row[keep], shard[keep], sim[keep]
        order = np.lexsort((-sim, home[row] != shard, row))
        row, shard = row[order], shard[order]
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        place = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
        keep = place < probed
        row, shard = row[keep], shard[keep]
        return row, shard, home[row] == shard


def _route(tree, margin: float, probed: int):
    """Each vector to its own shard (home) and to the others it is searched in; piece says which part of a shard indexes it, part which part of its queries it is in."""

    def run(batches):
        t = tree.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                row, shard, home = t.route(_unit(part.column(1)), margin, probed)
                h = (part.column(0).to_numpy()[row].view(np.uint64) * _MIX >> np.uint64(33)).astype(np.int64)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.astype(np.int32)), pa.array((h % t.pieces[shard]).astype(np.int32)), pa.array((h % t.parts[shard]).astype(np.int32)), pa.array(home), part.column(0).take(rows), part.column(1).take(rows)],
                    names=["shard", "piece", "part", "home", "vid", "vector"],
                )

    return run


def _sizes(tree, margin: float, probed: int):
    """(shard, homes, queries) of each batch."""

    def run(batches):
        t = tree.value
        homes, queries = np.zeros(t.shards, np.int64), np.zeros(t.shards, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                _, shard, home = t.route(_unit(batch.slice(lo, 4096).column(1)), margin, probed)
                queries += np.bincount(shard, minlength=t.shards)
                homes += np.bincount(shard[home], minlength=t.shards)
        at = np.flatnonzero(queries)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(homes[at]), pa.array(queries[at])], names=["shard", "homes", "queries"])

    return run


def _homes(tree, every: np.ndarray):
    """A sample of the vectors of the shards to divide: one in every[shard], none where that is 0."""

    def run(batches):
        t = tree.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                row, shard, home = t.route(_unit(part.column(1)), 0.0, 1)
                shard = shard[home][np.argsort(row[home])]
                h = (part.column(0).to_numpy().view(np.uint64) * _MIX >> np.uint64(20)).astype(np.int64)
                keep = (every[shard] > 0) & (h % np.maximum(every[shard], 1) == 0)
                yield pa.RecordBatch.from_arrays([pa.array(shard[keep].astype(np.int32)), part.column(1).filter(pa.array(keep))], names=["shard", "vector"])

    return run


def _divided(wanted: dict[int, int]):
    def run(t: pa.Table) -> pa.Table:
        shard = t["shard"][0].as_py()
        c = fit_centroids(_unit(t["vector"]), wanted[shard])
        return pa.table({"shard": pa.array([shard], pa.int32()), "centroids": [c.tobytes()]})

    return run


def fit_tree(vectors: DataFrame, total: int, shard_size: int, margin: float, probed: int) -> Tree | None:
    """The tree whose shards have at most twice shard_size vectors; the driver gets a bounded sample and the centroids."""
    spark = vectors.sparkSession
    size = max(shard_size, -(-total // MOST_SHARDS))
    first = max(1, min(4 * BRANCHES, ceil(total / size)))
    every = max(1, total // max(8192, first * PER_SHARD_SAMPLE))
    sample = vectors.where(F.pmod(F.xxhash64("vid"), F.lit(every)) == 0).select("vector").toArrow()
    if not sample.num_rows:
        sample = vectors.select("vector").limit(1).toArrow()
    if not sample.num_rows:
        return None
    tree = Tree(fit_centroids(_unit(sample["vector"]), first))
    for level in range(LEVELS + 1):
        shared = spark.sparkContext.broadcast(tree)
        counts = vectors.select("vid", "vector").mapInArrow(_sizes(shared, margin, probed), "shard int, homes long, queries long").groupBy("shard").agg(F.sum("homes").alias("homes"), F.sum("queries").alias("queries")).toArrow()
        at, homes, queries = (counts[c].to_numpy() for c in ("shard", "homes", "queries"))
        large = homes > 2 * size
        tree.parts[at] = np.maximum(1, -(-queries // (PART * size)))
        if level == LEVELS:
            tree.pieces[at[large]] = -(-homes[large] // size)
        if level == LEVELS or not large.any():
            return tree
        wanted = {int(s): int(min(BRANCHES, -(-n // size))) for s, n in zip(at[large], homes[large])}
        rate = np.zeros(tree.shards, np.int64)
        for s, n in zip(at[large].tolist(), homes[large].tolist()):
            rate[s] = max(1, n // (wanted[s] * PER_SHARD_SAMPLE))
        picked = vectors.select("vid", "vector").mapInArrow(_homes(shared, rate), "shard int, vector array<float>")
        for shard, data in zip(*(c.to_pylist() for c in picked.groupBy("shard").applyInArrow(_divided(wanted), "shard int, centroids binary").toArrow().columns)):
            tree.divide(shard, np.frombuffer(data, np.float32).reshape(-1, tree.nodes[0].shape[1]))
    return tree


def _index(links: int, width: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("vid")
        g = build(_unit(t["vector"]), links, width)
        return pa.table({"shard": pa.array([t["shard"][0].as_py()], pa.int32()), "piece": pa.array([t["piece"][0].as_py()], pa.int32()), "n": pa.array([t.num_rows], pa.int32()), "vids": [t["vid"].to_numpy().tobytes()], **{k: [v] for k, v in g.to_bytes().items()}})

    return run


def _search(k: int, width: int):
    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        out_type = pa.list_(pa.struct([("sim", pa.float64()), ("vid", pa.int64())]))
        if not queries.num_rows or not index.num_rows:
            return pa.table({"vid": pa.array([], pa.int64()), "near": pa.array([], out_type)})
        row = index.slice(0, 1).to_pylist()[0]
        vids = np.frombuffer(row["vids"], np.int64)
        g = Graph.from_bytes(row["n"], row["vectors"], row["base"], row["upper"])
        own, parts = queries["vid"].to_numpy(), []
        for lo in range(0, len(own), 8192):
            part = queries.slice(lo, 8192)
            q = _unit(part["vector"])
            nodes, _ = g.search(q, max(width, k + 1))
            sims = np.einsum("qd,qnd->qn", q.astype(np.float64), g.vectors[nodes].astype(np.float64))
            near = vids[nodes]
            good = (nodes >= 0) & (near != own[lo : lo + 8192, None])
            sims = np.where(good, sims, -9)
            best = np.argsort(-sims, 1, kind="stable")[:, :k]
            sims, near = np.take_along_axis(sims, best, 1), np.take_along_axis(near, best, 1)
            keep = sims > -9
            offsets = np.concatenate([[0], np.cumsum(keep.sum(1))]).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(sims[keep]), pa.array(near[keep])], names=["sim", "vid"])
            parts.append(pa.table({"vid": part["vid"], "near": pa.ListArray.from_arrays(pa.array(offsets), items)}))
        return pa.concat_tables(parts)

    return run


def nearest_distinct(vectors: DataFrame, k: int = K, shard_size: int = SHARD_SIZE, margin: float = MARGIN, width: int = SEARCH_WIDTH, probed: int = PROBED) -> DataFrame:
    """(vid, near array<struct<sim double, vid long>>), best first; vectors has distinct vid long, vector array<float>."""
    spark = vectors.sparkSession
    total = vectors.count()
    tree = fit_tree(vectors, total, shard_size, margin, probed)
    if tree is None:
        return spark.createDataFrame([], "vid long, near array<struct<sim:double,vid:long>>")
    routed = vectors.select("vid", "vector").mapInArrow(_route(spark.sparkContext.broadcast(tree), margin, probed), "shard int, piece int, part int, home boolean, vid long, vector array<float>")
    # Groups are placed by hash, so there are several partitions a group while groups are few, lest some get two or three.
    groups = int((tree.parts * tree.pieces).sum())
    tasks = max(partitions(spark), groups, min(8 * groups, 512))
    homes = routed.where("home").select("shard", "piece", "vid", "vector").repartition(tasks, "shard", "piece")
    index = written(homes.groupBy("shard", "piece").applyInArrow(_index(LINKS, BUILD_WIDTH), _INDEX), "graphs")
    counts = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(tree.pieces, tree.parts)) if a * b > 1], "shard int, pieces int, parts int")
    # Only shards in several pieces or parts are copied: queries to each piece, graphs to each part.
    one = lambda c, column: F.explode(F.sequence(F.lit(0), F.coalesce(column, F.lit(1)) - 1)).alias(c)
    graphs = index.join(F.broadcast(counts.select("shard", "parts")), "shard", "left").select(*index.columns, one("part", F.col("parts"))).repartition(tasks, "shard", "piece", "part")
    asked = routed.drop("piece", "home")
    if (tree.pieces > 1).any():
        asked = asked.join(F.broadcast(counts.select("shard", "pieces")), "shard", "left").select("shard", "part", "vid", "vector", one("piece", F.col("pieces")))
    else:
        asked = asked.withColumn("piece", F.lit(0))
    asked = asked.repartition(tasks, "shard", "piece", "part")
    keys = ["shard", "piece", "part"]
    found = asked.groupBy(*keys).cogroup(graphs.groupBy(*keys)).applyInArrow(_search(k, width), "vid long, near array<struct<sim:double,vid:long>>")
    merged = F.sort_array(F.flatten(F.collect_list("near")), asc=False)
    return found.groupBy("vid").agg(F.slice(merged, 1, k).alias("near"))


def similar_chunks(chunks: DataFrame, k: int = K, dimension: int = DIMENSION, **search) -> DataFrame:
    """(chunk_id, near array<string>): the k most similar other chunks, best first."""
    rows = chunks.where("chunk_id is not null").select("chunk_id", "created_at", F.col("embedding").cast("array<float>").alias("vector"))
    rows = rows.where(usable(F.col("vector"), dimension)).withColumn("vid", F.xxhash64("vector"))
    members = written(rows.groupBy("chunk_id").agg(F.max_by("vid", F.struct("created_at", "vid")).alias("vid")), "members")
    first = members.withColumn("at", F.row_number().over(W.partitionBy("vid").orderBy("chunk_id"))).where(F.col("at") <= k + 1)
    classes = written(first.groupBy("vid").agg(F.array_sort(F.collect_list("chunk_id")).alias("ids")), "classes")
    vectors = rows.groupBy("vid").agg(F.first("vector").alias("vector")).join(classes.select("vid"), "vid", "left_semi")
    near = nearest_distinct(written(vectors, "vectors"), k, **search)
    each = near.select("vid", F.posexplode("near").alias("at", "x")).select("vid", "at", F.col("x.vid").alias("other"))
    opened = each.join(classes.select(F.col("vid").alias("other"), F.slice("ids", 1, k).alias("ids")), "other")
    others = opened.groupBy("vid").agg(F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])), 1, k).alias("others"))
    whole = classes.join(others, "vid", "left").withColumn("others", F.coalesce("others", F.array().cast("array<string>")))
    small = whole.where(F.size("ids") <= k).select(F.explode("ids").alias("chunk_id"), "ids", "others")
    large = members.join(whole.where(F.size("ids") > k), "vid").select("chunk_id", "ids", "others")
    mine = F.filter("ids", lambda x: x != F.col("chunk_id"))
    return small.unionByName(large).select("chunk_id", F.slice(F.concat(mine, "others"), 1, k).alias("near"))


def similar_pairs(chunks: DataFrame, k: int = K, **search) -> DataFrame:
    """(chunk_id_a, chunk_id_b), a < b: distinct pairs of which one is among the k most similar of the other."""
    each = similar_chunks(chunks, k, **search).select("chunk_id", F.explode("near").alias("other"))
    return each.select(F.least("chunk_id", "other").alias("chunk_id_a"), F.greatest("chunk_id", "other").alias("chunk_id_b")).distinct()

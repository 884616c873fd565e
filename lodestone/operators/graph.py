"""Operators on directed graphs given as edges (src, dst), optionally within a partition column.

Loops run until nothing changes; where a bound on the rounds is given and met before that, they raise. Each round's result is
written to the shared folder, so plans stay short and a lost executor costs one round at most. Nothing is collected but counts.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import written


def clean_edges(edges: DataFrame) -> DataFrame:
    """Each edge once, without self-loops and missing ends."""
    return edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, other): both directions, each once."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other")))
    return both.distinct()


def within(edges: DataFrame, seeds: DataFrame, depth: int, directed: bool = False) -> DataFrame:
    """(seed, node, distance) of every node at distance 1..depth from a seed, the shortest distance, the seed itself left out."""
    near = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).distinct() if directed else neighbours(edges)
    near = written(near, "neighbours")
    reached = written(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("distance")).distinct(), "reached")
    front = reached
    for d in range(1, depth + 1):
        step = front.select("seed", "node").join(near, "node").select("seed", F.col("other").alias("node")).distinct()
        front = written(step.join(reached, ["seed", "node"], "left_anti").withColumn("distance", F.lit(d)), "front")
        reached = reached.unionByName(front)
    return reached.where("distance > 0")


class Unfinished(RuntimeError):
    """A loop met its bound on rounds before its end."""


def reachable(edges: DataFrame, pairs: DataFrame, most: int | None = None) -> DataFrame:
    """pairs (seed, node) with `found`: whether a directed path leads from seed to node. Unfinished, if some path may have more than `most` edges."""
    near = written(edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).distinct(), "edges")
    reached = written(pairs.select("seed", F.col("seed").alias("node")).distinct(), "reached")
    front = reached
    for n in count():
        if n == most:
            raise Unfinished(f"new nodes are reached after {most} edges")
        step = front.join(near, "node").select("seed", F.col("other").alias("node")).distinct()
        front = written(step.join(reached, ["seed", "node"], "left_anti"), "front")
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    found = reached.withColumn("found", F.lit(True))
    return pairs.join(found, ["seed", "node"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def components(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, component): connected components, undirected, named by their smallest node.

    Alternates large-star and small-star steps until no edge changes, which takes a number of rounds in the order of the logarithm
    of the longest path, and keeps a node of any degree from meeting all its neighbours' neighbours.
    """
    e = written(clean_edges(edges).select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")

    def stars(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            return both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(smallest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        return moved.where("u <> v").distinct()

    state = None
    for n in count():
        if n == most:
            raise Unfinished(f"components change after {most} rounds")
        e = written(stars(stars(e, True), False), "stars")
        now = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if now == state:
            break
        state = now
    label = e.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.select("node").distinct().join(label, F.col("node") == F.col("u"), "left").select("node", F.coalesce("component", "node").alias("component"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return nodes.select("node").distinct().join(ends, "node", "left_anti")


def unreferenced(nodes: DataFrame, edges: DataFrame, entry_points: DataFrame) -> DataFrame:
    """Nodes with outgoing edges that nothing points to and that are no entry points."""
    e = clean_edges(edges)
    sources = nodes.select("node").join(e.select(F.col("src").alias("node")), "node", "left_semi").distinct()
    return sources.join(e.select(F.col("dst").alias("node")), "node", "left_anti").join(entry_points.select("node"), "node", "left_anti")


def edge_faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fault, n): edges with a missing end, self-loops, and repeats of an edge."""
    known = nodes.select("node").distinct()
    missing = edges.join(known, edges["src"] == known["node"], "left_anti").unionByName(edges.join(known, edges["dst"] == known["node"], "left_anti")).distinct()
    loops = edges.where("src = dst")
    repeats = edges.groupBy("src", "dst").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))
    total = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("fault"), "n")
    return total(missing, "missing_end").unionByName(total(loops, "self_loop")).unionByName(repeats.select(F.lit("repeat").alias("fault"), "n"))


def short_cycles(edges: DataFrame) -> DataFrame:
    """(a, b, c): directed cycles of two nodes (c null) and three, each once, beginning with its smallest node."""
    e = written(clean_edges(edges), "edges")
    x, y, z = (e.select(F.col("src").alias(p), F.col("dst").alias(q)) for p, q in (("a", "b"), ("b", "c"), ("c", "a")))
    two = x.join(e.select(F.col("src").alias("b"), F.col("dst").alias("a")), ["a", "b"]).where("a < b").select("a", "b", F.lit(None).cast(dict(e.dtypes)["src"]).alias("c"))
    three = x.join(y, "b").where("a < b and a < c").join(z, ["c", "a"]).select("a", "b", "c")
    return two.unionByName(three)


def updated(nodes: DataFrame, edges: DataFrame, changes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after changes (change, file_path, old_path): added, modified, deleted or renamed files.

    A deleted file goes with all of its edges; a renamed one keeps them under its new name, before the rest is applied; the outgoing
    edges of added and modified files are those of `new_edges` (src, dst), as far as both ends are there.
    """
    moved = changes.where("change = 'renamed' and old_path is not null").groupBy("old_path").agg(F.max("file_path").alias("to"))
    to = lambda df, c: df.join(moved, F.col(c) == F.col("old_path"), "left").withColumn(c, F.coalesce("to", c)).drop("old_path", "to")
    gone = changes.where("change = 'deleted'").select(F.col("file_path").alias("node")).distinct()
    touched = changes.where("change in ('added', 'modified')").select(F.col("file_path").alias("node")).distinct()
    kept = to(nodes.select("node"), "node").unionByName(touched).unionByName(moved.select(F.col("to").alias("node"))).distinct().join(gone, "node", "left_anti")
    e = to(to(edges.select("src", "dst"), "src"), "dst").join(touched.withColumnRenamed("node", "src"), "src", "left_anti").select("src", "dst")
    e = e.unionByName(new_edges.select("src", "dst").join(touched.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst"))
    e = clean_edges(e).join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return kept, e.select("src", "dst")


def _adjacency(t) -> dict:
    out: dict = {}
    for a, b in sorted(set(zip(t["src"].to_pylist(), t["dst"].to_pylist()))):
        if a is not None and b is not None and a != b:
            out.setdefault(a, []).append(b)
    return out


def preorder(edges: DataFrame, starts: DataFrame, graph: str, depth: int | None = None) -> DataFrame:
    """(graph, start, node, position): nodes in the order in which a depth-first walk from start meets them, targets by name.

    edges is (graph, src, dst), starts is (graph, start). A walk's order is sequential, so each graph (the files of a repository) is one task's.
    """
    import pyarrow as pa

    def run(e: pa.Table, s: pa.Table) -> pa.Table:
        near, rows = _adjacency(e), []
        name = (s if s.num_rows else e)[graph][0].as_py()
        for start in sorted({x for x in s["start"].to_pylist() if x is not None}):
            seen, stack, at = {start}, [(iter(near.get(start, [])), 0)], 1
            rows.append((start, start, 0))
            while stack:
                step, d = stack[-1]
                node = next((x for x in step if x not in seen), None) if depth is None or d < depth else None
                if node is None:
                    stack.pop()
                    continue
                seen.add(node)
                rows.append((start, node, at))
                at += 1
                stack.append((iter(near.get(node, [])), d + 1))
        cols = list(zip(*rows)) if rows else [[]] * 3
        return pa.table({graph: pa.array([name] * len(rows), pa.string()), "start": pa.array(cols[0], pa.string()), "node": pa.array(cols[1], pa.string()), "position": pa.array(cols[2], pa.int32())})

    return edges.groupBy(graph).cogroup(starts.groupBy(graph)).applyInArrow(run, f"{graph} string, start string, node string, position int")


def cycles(edges: DataFrame, graph: str) -> DataFrame:
    """(graph, path): the cycles that closing edges of a depth-first walk show, each set of nodes once, from its smallest node and back to it.

    edges is (graph, src, dst); each graph is one task's, as in `preorder`.
    """
    import pyarrow as pa

    def run(e: pa.Table) -> pa.Table:
        near, done, found = _adjacency(e), set(), {}
        for start in sorted(near):
            if start in done:
                continue
            path, place, stack = [start], {start: 0}, [iter(near[start])]
            while stack:
                node = next(stack[-1], None)
                if node is None:
                    stack.pop()
                    last = path.pop()
                    del place[last]
                    done.add(last)
                elif node in place:
                    ring = path[place[node] :]
                    low = ring.index(min(ring))
                    found.setdefault(frozenset(ring), [*ring[low:], *ring[:low], ring[low]])
                elif node not in done:
                    place[node] = len(path)
                    path.append(node)
                    stack.append(iter(near.get(node, [])))
        paths = sorted(found.values())
        return pa.table({graph: pa.array([e[graph][0].as_py()] * len(paths), pa.string()), "path": pa.array(paths, pa.list_(pa.string()))})

    return edges.select(graph, "src", "dst").groupBy(graph).applyInArrow(run, f"{graph} string, path array<string>")


def knowledge(kinds: dict[str, DataFrame], edges: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(node, kind) and (src, dst, relation) of several kinds of nodes and edges, each once; a node of several kinds has a row for each."""
    nodes = [df.select("node", F.lit(k).alias("kind")) for k, df in kinds.items()]
    links = [df.select("src", "dst", F.lit(r).alias("relation")) for r, df in edges.items()]
    n, e = nodes[0], links[0]
    for x in nodes[1:]:
        n = n.unionByName(x)
    for x in links[1:]:
        e = e.unionByName(x)
    return n.distinct(), e.where("src is not null and dst is not null").distinct()

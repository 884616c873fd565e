import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import graph_index, similar_vectors as sv


def _clustered(n, seed=0, per=9):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(n // per + 1, 64))
    return (c[np.arange(n) // per] + 0.3 * rng.normal(size=(n, 64))).astype(np.float32)


def _brute(x, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u.astype(np.float64) @ u.T.astype(np.float64)
    np.fill_diagonal(s, -9)
    return np.argsort(-s, 1)[:, :k]


def test_graph_recall_and_bytes():
    x = _clustered(5000)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    g = graph_index.build(u, 12, 32)
    assert g.layers
    g = graph_index.Graph.from_bytes(len(u), *g.to_bytes().values())
    ids, _ = g.search(u, 24)
    true = _brute(x, 5)
    hit = np.mean([len(set(t) & set(i[:6])) / 5 for t, i in zip(true, ids)])
    assert hit > 0.95


def _frame(spark, x, extra=()):
    rows = [(f"c{i:05d}", [float(y) for y in v], i) for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, *extra], "chunk_id string, embedding array<float>, created_at int").withColumn("created_at", F.timestamp_seconds("created_at"))


def test_recall_over_several_shards(spark):
    x = _clustered(3000, 3)
    got = {(r.chunk_id_a, r.chunk_id_b) for r in sv.similar_pairs(_frame(spark, x), shard_size=700).collect()}
    want = {tuple(sorted((f"c{i:05d}", f"c{j:05d}"))) for i, row in enumerate(_brute(x, 5)) for j in row}
    assert len(got & want) / len(want) > 0.97 and len(got & want) / len(got) > 0.97


def test_dirty_rows_copies_and_empty(spark):
    x = _clustered(12, 1, per=6)
    bad = [("n", None, 1), ("w", [1.0] * 32, 1), ("z", [0.0] * 64, 1), ("q", [float("nan")] * 64, 1), ("i", [float("inf")] + [1.0] * 63, 1), (None, [1.0] * 64, 1), ("m", [None] + [1.0] * 63, 1)]
    same = [float(v) for v in x[0]]
    copies = [(f"x{i}", same, 1) for i in range(9)] + [("c00003", [float(v) for v in x[3]], 99)]
    df = _frame(spark, x, bad + copies).withColumn("vid", F.lit("clash"))
    near = {r.chunk_id: r.near for r in sv.similar_chunks(df).collect()}
    assert set(near) == {f"c{i:05d}" for i in range(12)} | {f"x{i}" for i in range(9)}
    assert near["x0"] == ["c00000", "x1", "x2", "x3", "x4"] and near["c00000"] == ["x0", "x1", "x2", "x3", "x4"]
    assert all(len(v) == 5 and k not in v for k, v in near.items())
    assert sv.similar_pairs(df.limit(0)).collect() == []
    assert sv.similar_pairs(_frame(spark, x[:1])).collect() == []
    two = _frame(spark, np.stack([x[0], 2 * x[0]]))
    assert [tuple(r) for r in sv.similar_pairs(two).collect()] == [("c00000", "c00001")]


def test_centroids():
    x = _clustered(50)
    assert sv.fit_centroids(x, 4).shape == (4, 64) and sv.fit_centroids(x[:2], 9).shape == (2, 64)
    with pytest.raises(ValueError):
        sv.fit_centroids(x[:0], 1)


def test_shards_stay_small_with_a_third_in_one_cluster(spark):
    rng = np.random.default_rng(8)
    x = _clustered(6000, 8, per=40)
    x[:2000] = 1.5 * rng.normal(size=64) + 0.25 * rng.normal(size=(2000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vid long, vector array<float>")
    tree = sv.fit_tree(df, len(x), 400, sv.MARGIN, sv.PROBED)
    row, shard, home = tree.route(sv._unit(df.select("vector").toArrow()["vector"]), sv.MARGIN, sv.PROBED)
    assert home.sum() == len(x) and np.bincount(shard[home]).max() <= 800 and (tree.pieces == 1).all()
    assert np.bincount(row).max() <= sv.PROBED
    got = {r.vid: [y.vid for y in r.near] for r in sv.nearest_distinct(df, shard_size=400).collect()}
    assert all(len(set(v)) == 5 for v in got.values())
    assert np.mean([len(set(got[i]) & set(t)) / 5 for i, t in enumerate(_brute(x, 5).tolist())]) > 0.9


def test_what_centroids_cannot_divide_is_divided_by_hash(spark):
    rng = np.random.default_rng(9)
    x = (np.ones(64) + 1e-9 * rng.normal(size=(1200, 64))).astype(np.float64)
    x[:, 0] += np.arange(1200) * 1e-4
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vid long, vector array<float>")
    tree = sv.fit_tree(df, len(x), 50, 0.13, 3)
    tree.pieces[:] = 2
    assert sv.nearest_distinct(df, shard_size=50).count() == 1200

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import mixing as m
from lodestone.llm.tokens import encoder


def test_permutation():
    for size in (1, 2, 3, 7, 64, 1000):
        for key in (0, 5, 1 << 60):
            got = m.permuted(np.arange(size), np.full(size, size), np.full(size, key))
            assert sorted(got.tolist()) == list(range(size))
    assert m.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 3)).tolist() != list(range(1000))


def test_plan():
    p = m.plan({"a": 10_000, "b": 500}, {"a": (0.5, 1), "b": (0.3, 4), "none": (0.2, 9)}, 10)
    assert p["none"]["slots"] == 0 and p["b"]["slots"] == 200 and p["a"]["slots"] == 333
    assert m.plan({}, {"a": (1.0, 1)}, 10)["a"]["slots"] == 0


def test_draw(spark):
    slots = {"a": 333, "b": 200, "none": 0}
    for groups in (1, 2, 512):
        d = m.draw(spark, slots, 100, 1, groups).collect()
        for at, total in enumerate(slots.values()):
            mine = sorted((r["first"], r["count"]) for r in d if r["at"] == at)
            assert sum(n for _, n in mine) == total and all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:]))
        assert [sum(r["count"] for r in d if r["shard"] == k) for k in range(6)] == [100] * 5 + [33]
    assert m.draw(spark, {}, 10, 1).collect() == [] and m.draw(spark, {"a": 0}, 10, 1).collect() == []


def test_draw_of_very_many_blocks_stays_on_the_tasks():
    slots = {"a": 70_000_000_000, "b": 29_000_000_000, "c": 7}
    rows = m.grouped(slots, 1024, 3)
    assert len(rows) <= m.GROUPS and [sum(r[3][i] for r in rows) for i in range(3)] == list(slots.values())
    shares = [r[3][0] / sum(r[3]) for r in rows]
    assert all(abs(x - 70 / 99) < 0.001 for x in shares) and len(set(shares)) > 1


def _docs(spark):
    rows = [(i, f"word{i} some text of a document number {i} " * (1 + i % 5), s, 1) for i in range(120) for s in (["a", " A", "b-c", "B_C ", "x", None, ""][i % 7],)]
    rows += [(1000, None, "a", 1), (1001, "", "a", 1), (3, "again the same id", "a", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, row int")


def test_mixture(spark):
    docs = _docs(spark)
    targets = spark.createDataFrame([("a", 0.5, 2), ("b_c", 0.4, 3), ("gone", 0.1, 5), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed, report = m.mixture(docs, targets, block=16, shard_blocks=8)
    rows, shares = mixed.collect(), {r.source: r for r in report.collect()}
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(encoder().bpe.encode_ordinary(r.text or ""))
    used, per = {}, {}
    for r in rows:
        assert r.n_tokens == len(r.ids) == sum(p["count"] for p in r.pieces) and r.n_tokens <= 16
        at = 0
        for p in r.pieces:
            part = r.ids[at : at + p["count"]]
            assert any(t[p["first"] : p["first"] + p["count"]] == part for t in texts[p["doc_id"]])
            at += p["count"]
            for k in range(p["first"], p["first"] + p["count"]):
                used[r.source, p["doc_id"], k] = used.get((r.source, p["doc_id"], k), 0) + 1
        per[r.source] = per.get(r.source, 0) + r.n_tokens
    total = sum(per.values())
    assert set(shares) == {"a", "b_c", "gone"} and shares["gone"].actual_share == 0
    for s, cap in (("a", 2), ("b_c", 3)):
        assert shares[s].mixed_tokens == per[s] and abs(shares[s].actual_share - per[s] / total) < 1e-9
        assert shares[s].most_repeats <= cap and max(v for (k, d, _), v in used.items() if k == s and d != 3) <= cap
        assert abs(per[s] / total - shares[s].share_of_available) < 32 / total
    assert sorted((r.shard, r.slot) for r in rows) == [(i // 8, i % 8) for i in range(len(rows))]
    again = m.mixture(docs, targets, block=16, shard_blocks=8)[0].select("shard", "slot", "block_no").collect()
    assert {tuple(x) for x in again} == {(r.shard, r.slot, r.block_no) for r in rows}


def test_empty(spark):
    docs = _docs(spark)
    targets = spark.createDataFrame([("a", 0.5, 2)], "source string, target_share double, max_repeats int")
    mixed, report = m.mixture(docs.where(F.lit(False)), targets)
    assert mixed.collect() == [] and [r.actual_share for r in report.collect()] == [0.0]
    mixed, report = m.mixture(docs, targets.limit(0))
    assert mixed.collect() == [] and report.collect() == []

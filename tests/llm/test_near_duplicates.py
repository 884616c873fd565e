import random
import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import near_duplicates as nd


def _set(text, words=3):
    w = re.findall("[a-z0-9_]+", (text or "").lower())
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def _brute(rows, t=0.6):
    sets = {k: _set(x) for k, x in rows if k is not None and x is not None}
    out = set()
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 10 * len(x & y) >= 10 * t * len(x | y):
            out.add((a, b))
    return out


def _frame(spark, rows):
    return spark.createDataFrame([(k, x, 1) for k, x in rows], "chunk_id string, content string, key int")


def _corpus(n, seed=0, boiler=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    head = [f"h{i}" for i in range(boiler)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randrange(12)):
                w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = head + rng.choices(words, k=rng.choice([3, 8, 20, 60, 150]))
        rows.append((f"k{i:04d}", " ".join(w)))
    return rows


def test_shingles():
    assert [len(nd.shingles(t)) for t in (None, "", "a b", "a b c", "A-b_c, d", "a b c a b c a b c", "日本 語")] == [0, 0, 0, 1, 1, 3, 0]
    assert np.array_equal(nd.shingles("A b\r\nC"), nd.shingles("a  b c!"))
    assert nd.lost_pairs(0.6) < 1e-4 and nd.lost_pairs(0.8) < 1e-9
    assert len(nd.shingles("a b " * 500_000)) == 2


def test_all_pairs_found(spark):
    rows = _corpus(300) + [("n1", None), ("n2", ""), ("n3", "a b"), (None, "x y z")]
    got = [tuple(r) for r in nd.near_duplicate_pairs(_frame(spark, rows + rows[:5])).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(rows)


def test_shared_text_and_small_lists(spark):
    rows = _corpus(250, 2, boiler=60)
    got = {tuple(r) for r in nd.near_duplicate_pairs(_frame(spark, rows), frequent=4).collect()}
    want = _brute(rows)
    assert got <= want and len(got) >= 0.999 * len(want)


def test_copies_and_empty(spark):
    rows = [(f"c{i:02d}", "same text in all of them") for i in range(12)] + [("d", "same text in all of us"), ("e", "nothing like the others")]
    df = _frame(spark, rows)
    got = {tuple(r) for r in nd.near_duplicate_pairs(df).collect()}
    assert got == _brute(rows) and len(got) >= 66
    classes = {r.chunk_id: (r.copies, r.links) for r in nd.near_duplicates(df, threshold=0.5).collect()}
    assert classes["c00"] == (11, 1) and classes["d"] == (0, 1) and classes["e"] == (0, 0)
    assert nd.near_duplicate_pairs(df.limit(0)).collect() == [] and nd.near_duplicates(df.where(F.lit(False))).collect() == []


def test_low_threshold_and_many_frequent_values(spark):
    rows = _corpus(120, 7, boiler=30)
    got = {tuple(r) for r in nd.near_duplicate_pairs(_frame(spark, rows), threshold=0.4, frequent=3, least_shared=2).collect()}
    want = _brute(rows, 0.4)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_short_texts_in_many_classes(spark):
    rows = [("s", "a b c d"), ("r", "e f e f e f")] + [(f"x{i:02d}", f"a b c d x{i}") for i in range(9)] + [(f"y{i:02d}", f"e f e f y{i}") for i in range(20)]
    want = _brute(rows)
    assert len(want) >= 29
    assert {tuple(r) for r in nd.near_duplicate_pairs(_frame(spark, rows)).collect()} == want
    links = {r.chunk_id: r.links for r in nd.near_duplicates(_frame(spark, rows)).collect()}
    assert links["s"] == 9 and links["r"] == 20 and links["x00"] == 1


def test_a_single_shared_value_can_do(spark):
    rows = _corpus(120, 9, boiler=30) + [(f"x{i:02d}", f"a b c d x{i}") for i in range(12)] + [("s", "a b c d")]
    got = {tuple(r) for r in nd.near_duplicate_pairs(_frame(spark, rows), frequent=3, least_shared=1).collect()}
    assert got == _brute(rows)


def _headed(n, shared, own):
    rng = random.Random(n)
    head = " ".join(f"h{i}" for i in range(shared))
    return [nd.shingles(head + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(own))) for _ in range(n)]


def test_a_shared_header_makes_no_candidates(spark):
    """Half of the words of all texts are a header, so each two have a similarity of a third."""
    for n in (250, 500, 1000):
        each = _headed(n, 70, 70)
        sketches = spark.createDataFrame([(i, len(v), v[:24].tolist()) for i, v in enumerate(each)], "c long, n int, sketch array<long>")
        values = nd._ordered(sketches, 0.6, 5)
        crowded = values.where("f > 8").select("c").distinct()
        assert crowded.count() > 0.9 * n
        sets = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(each)], "c long, whole array<long>")
        assert nd._on_whole_sets(sets, 0.6).count() == 0
        # A few of the header's values stand at the end of few sketches; such lists have eight classes at most.
        assert nd._pairs_of(values.where("f <= 8").select("c", F.col("v").alias("key"))).count() <= 200


def test_filter(spark):
    c = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)
    bits = nd._filter(spark.createDataFrame([(int(x),) for x in c], "c long"))
    assert nd._holds(bits, c).all() and nd._holds(bits, c + 1).mean() < 0.01

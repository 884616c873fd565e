import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import splitting as s


def check(text, limit, overlap):
    pieces = s.cut(text, limit, overlap)
    assert all(max(1, (b - a) // 4) <= limit for a, b in pieces)
    assert all(y[0] == x[1] - 4 * overlap and y[1] > x[1] for x, y in zip(pieces, pieces[1:]))
    assert "".join(text[a + (4 * overlap if k else 0) : b] for k, (a, b) in enumerate(pieces)) == text
    return pieces


def test_random_texts():
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choices(["word", " ", "\n", "\n\n", ". ", "日", "x" * 30], k=rng.randrange(200)))
        check(text, rng.randrange(3, 30), rng.randrange(3))


def test_boundaries():
    text = "a" * 20 + "\n" + "b" * 20
    assert check(text, 6, 1) [0] == (0, 21)
    assert check("z" * 100, 5, 1)[0] == (0, 23)
    assert s.cut("") == [] and s.cut("a") == [(0, 1)]
    with pytest.raises(ValueError):
        s.cut("a" * 99, 5, 5)


def test_very_long_text():
    check("line of text\n" * 400_000, 1024, 100)


def test_frame(spark):
    long, short = "one two\r\n" * 2000, "x\ny\n"
    rows = [("a", long, 5, 1, "z"), ("a", long, 5, 2, "z"), ("b", short, None, 1, "z"), ("c", None, 1, 1, "z"), ("d", "", 1, 1, "z"), (None, long, 1, 1, "z"), ("e", "x" * 4099, 1, 1, ""), ("f", "x" * 4100, 1, 1, "")]
    df = spark.createDataFrame(rows, "chunk_id string, content string, start_line int, created_at int, piece_no string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    got = s.oversized_pieces(df).orderBy("chunk_id", "piece_no").collect()
    assert {r.chunk_id for r in got} == {"a", "f"}
    a = [r for r in got if r.chunk_id == "a"]
    assert a[0].start_line == 5 and a[-1].end_line == 2004 and all(r.token_count <= 1024 for r in a)
    assert all(r.content.endswith("\n") for r in a)
    for r in a:
        assert r.end_line == r.start_line + r.content[:-1].count("\n")
    everything = {(r.chunk_id, r.piece_no): r for r in s.split_chunks(df).collect()}
    assert everything["b", 0].end_line == 2 and everything["b", 0].token_count == 1 and ("e", 0) in everything and ("d", 0) not in everything
    assert s.split_chunks(df.limit(0)).collect() == []

"""Functions and operators on small hand-made tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import files as fn
from lodestone.functions import questions, text, vectors
from lodestone.operators import changes, chunks, graph, profile, quality, retrieval, sections, snapshots
from lodestone.sources import files as src
from lodestone.session import new_path


def _one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("value,tokens", [(None, 0), ("", 0), ("abc", 1), ("a" * 8, 2), ("日本語文字", 1)])
def test_tokens(spark, value, tokens):
    assert _one(spark, text.estimate_tokens, value) == tokens


def test_identifiers(spark):
    assert _one(spark, text.identifier_words, "fooBar_baz.HTTPServer2-x") == ["foo", "bar", "baz", "http", "server2", "x"]
    assert _one(spark, text.keyword_forms, "fooBar") == ["foo bar", "foobar"] and _one(spark, text.keyword_forms, "foo") == ["foo"]
    assert _one(spark, text.telling_words, "getUserFromModule") == ["get", "user"]
    assert _one(spark, lambda c: text.phrases(text.identifier_words(c)), "a_b_c") == ["a", "b", "c", "a b", "b c", "a b c"]


def test_strings(spark):
    listed = [_one(spark, text.listed, v, "array<string>") for v in ([], ["a"], ["a", "b"], ["a", "b", "c"])]
    assert listed == ["", "a", "a and b", "a, b, and c"]
    assert _one(spark, text.without_thoughts, "<think>x</think>y<think>z") == "y"
    assert [_one(spark, text.requirement_name, v) for v in ("fastapi==0.1", "x>=2", "# c", "", "a[b]")] == ["fastapi", "x", None, None, "a"]
    assert _one(spark, text.unfenced, '```json\n{"a": 1}\n```') == '{"a": 1}'
    assert _one(spark, text.tidy_markdown, "a  \r\n\n\n\n```\nb") == "a\n\n```\nb\n```"
    assert _one(spark, lambda c: text.document_path(text.document_id(c)), "docs/ä b.md") == "docs/ä b.md"
    assert _one(spark, text.local_time, "2025-01-05T13:15:53+01:00") == "13:15:53"
    assert abs(_one(spark, text.sigmoid, 0.0, "double") - 0.5) < 1e-12


def test_paths(spark):
    cases = {"a/test_x.md": "Test", "a/x.py": "Source Code", "README.md": "Documentation", "Dockerfile": "Configuration", "x.sh": "Script", "x.png": "Asset", "x": "Unknown", ".env": "Configuration"}
    assert {p: _one(spark, fn.category, p) for p in cases} == cases
    assert [_one(spark, fn.extension, p) for p in ("a/B.PY", ".env", "a.b/c", "x.")] == ["py", "", "", ""]
    assert [_one(spark, fn.language, p) for p in ("a.tsx", "a.rst", "a.bin")] == ["tsx", "documentation", "unknown"]
    assert [_one(spark, fn.folder_kind, p) for p in ("", "x/API", "lib", "foo")] == ["Project Root", "API", "Utilities", "Feature Module"]
    assert not _one(spark, fn.is_supported, "node_modules/a.js") and _one(spark, fn.is_supported, "src/a.js")


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = [r.c for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert [round(x, 6) for x in got] == [0.96, 0.0, 0.0]
    assert df.select(vectors.l2_normalized(F.col("a")).alias("n")).first().n == [0.6, 0.8]


def test_questions(spark):
    cases = {"Who edited webhook.py?": "file_history", "What's in webhook.py?": "file_content", "What does this project do?": "general"}
    assert {q: _one(spark, questions.intent, q) for q in cases} == cases
    q = spark.createDataFrame([(1, "Who edited webhook.py?"), (2, "show me `app/main.py`"), (3, "nothing")], "query_id int, text string")
    f = spark.createDataFrame([("a/webhook.py",), ("b/webhook.py",), ("app/main.py",), ("x/main.py",)], "file_path string")
    assert {tuple(r) for r in questions.resolved_files(q, f).collect()} == {(1, "a/webhook.py"), (1, "b/webhook.py"), (2, "app/main.py")}


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "red red blue"), (2, "green"), (3, "green blue"), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([(0, ["red"]), (1, ["red", "red"]), (2, ["absent"])], "query_id long, terms array<string>")
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.bm25(docs, q).collect()}
    idf, mean = math.log(4 - 1 + 0.5) - math.log(1.5), 6 / 4
    want = idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / mean))
    assert set(got) == {(0, 1), (1, 1)} and abs(got[0, 1] - want) < 1e-6 and abs(got[1, 1] - 2 * want) < 1e-6


def test_fusion_does_not_depend_on_row_order(spark):
    rng = random.Random(1)
    rows = [(0, k, rng.random(), i + 1) for i, k in enumerate(rng.sample(range(50), 12))]
    make = lambda r: spark.createDataFrame(r, "query_id long, key long, score double, rank int")
    other = make([(0, k, 0.5, i + 1) for i, k in enumerate(range(20, 30))])
    one = [tuple(r) for r in retrieval.fuse({"a": make(rows), "b": other}, "key", 10).orderBy("rank").collect()]
    two = [tuple(r) for r in retrieval.fuse({"a": make(rows[::-1]), "b": other}, "key", 10).orderBy("rank").collect()]
    assert one == two and len(one) == 10
    assert retrieval.fuse({"a": make(rows).limit(0), "b": other}, "key", 3).count() == 3


def test_diversify_and_budget(spark):
    items = [(0, 1, 1, [1.0, 0.0]), (0, 2, 2, [1.0, 0.01]), (0, 3, 3, [0.0, 1.0]), (1, 1, 1, None), (1, 2, 2, [1.0]), (1, 3, 3, [1.0])]
    got = {(r.query_id, r.key): r.new_rank for r in retrieval.diversify(spark.createDataFrame(items, "query_id long, key long, rank int, vector array<double>")).collect()}
    assert got[0, 1] == 1 and got[0, 3] == 2 and got[0, 2] == 3 and [got[1, k] for k in (1, 2, 3)] == [1, 2, 3]
    b = spark.createDataFrame([("g", i, n) for i, n in enumerate([5, 6, 20, 1])], "g string, i int, n int")
    assert [r.i for r in retrieval.within_budget(b, "g", "i", "n", 12).orderBy("i").collect()] == [0, 1]


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "d"), ("f", "f"), ("a", "b"), (None, "x")], "src string, dst string")
    n = spark.createDataFrame([(x,) for x in "abcdefgh"], "node string")
    assert {tuple(r) for r in graph.components(n, e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "f"), ("g", "g"), ("h", "h")}
    assert {tuple(r) for r in graph.short_cycles(e).collect()} == {("d", "e", None), ("a", "b", "c")}
    assert {r.fault: r.n for r in graph.edge_faults(n, e.where("src is not null")).collect()} == {"missing_end": 0, "self_loop": 1, "repeat": 1}
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)], "src string, dst string")
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(41)], "node string")
    assert {r.component for r in graph.components(nodes, chain).collect()} == {"n000"}
    seeds = spark.createDataFrame([("a",)], "seed string")
    assert {(r.node, r.distance) for r in graph.within(e.where("src is not null"), seeds, 1).collect()} == {("b", 1), ("c", 1)}
    assert graph.within(e.limit(0), seeds, 2).collect() == [] and graph.components(n, e.limit(0)).count() == 8


def test_snapshots_incremental_equals_rebuild(spark):
    rng = random.Random(4)
    rows = lambda: [(f"c{i}", "r", f"h{rng.randrange(3)}", rng.random() < 0.8) for i in rng.sample(range(60), 40)]
    make = lambda r: spark.createDataFrame(r, "chunk_id string, repository string, content_hash string, active boolean")
    old, new = make(rows()), make(rows())
    after = snapshots.applied(old, new)
    live = lambda df: {(r.chunk_id, r.content_hash) for r in df.where("active").collect()}
    assert live(after) == live(new)
    acts = {r.chunk_id: r.action for r in snapshots.actions(after, new).collect()}
    assert set(acts.values()) <= {"skip"}
    assert snapshots.compacted(after, 0.0).where("not active").count() == 0
    assert snapshots.actions(old.limit(0), new.limit(0)).collect() == []


def test_hunks(spark):
    diff = "--- a\n+++ b\n@@ -1,3 +1,4 @@ def f\n x\n+y\n+z\n-q\n w\n@@ -10,2 +12,2 @@\n-a\n\\ No newline\n@@ -20 +30,2 @@\n c\n"
    df = spark.createDataFrame([("k", diff), ("e", "")], "key string, diff string")
    assert sorted((r.first_line, r.last_line) for r in changes.changed_lines(df).collect()) == [(2, 4), (12, 12), (30, 31)]


def test_sections(spark):
    docs = spark.createDataFrame([(1, "\n\na\nb\n\n \nc\n"), (2, None), (3, ""), (4, "x"), (5, "# T\n```\n# no\n```\n## U \ntext\n\n# \n")], "doc_id int, text string")
    assert [(r.doc_id, r.start_line, r.end_line, r.content) for r in sections.paragraphs(docs.where("doc_id < 5")).orderBy("doc_id", "start_line").collect()] == [(1, 3, 4, "a\nb"), (1, 7, 7, "c"), (4, 1, 1, "x")]
    got = [(r.heading, r.start_line, r.end_line) for r in sections.markdown_sections(docs.where("doc_id = 5")).orderBy("start_line").collect()]
    assert got == [("T", 1, 4), ("U", 5, 8)]


def test_quality(spark):
    docs = spark.createDataFrame([("a", "README.md", "## Overview\ntext"), ("b", "x/y.md", "## Overview\n```\n"), ("c", "x.md", " "), ("d", "x.md", "plain\n# \n")], "k string, p string, t string")
    got = {r.k: (r.missing, r.warnings, r.score) for r in quality.structure(docs, "k", F.col("p"), "t").collect()}
    assert got["a"] == (0, 0, 93.3) and got["b"][:2] == (2, 1) and got["c"][2] == 0.0 and got["d"][:2] == (1, 1)


def test_profile_and_filters(spark):
    c = spark.createDataFrame([("1", "r", "requirements.txt", "FastAPI==1", True, 1), ("2", "r", "src/a.py", "x", True, 1), ("2", "r", "src/a.py", "x", False, 2), ("3", "r", "src/b.py", " ", True, 1)], "chunk_id string, repository string, file_path string, content string, active boolean, created_at int").withColumns({"content_hash": F.col("content"), "created_at": F.timestamp_seconds("created_at"), "prog_lang": F.lit("Python")})
    assert [r.framework for r in profile.frameworks(c.withColumn("start_line", F.lit(1))).collect()] == ["FastAPI"]
    parts = spark.createDataFrame([("r", "requirements.txt", 1, "x" * 100), ("r", "requirements.txt", 2, "fastapi"), ("late", "requirements.txt", 1, "x" * 4090), ("late", "requirements.txt", 9, "fastapi"), ("n", "requirements.txt", None, None)], "repository string, file_path string, start_line int, content string")
    assert [r.repository for r in profile.frameworks(parts).collect()] == ["r"]
    kept = chunks.filter_chain(chunks.newest(c, "repository", "content", "active", "prog_lang"), repository="r", languages=["python"], missing="x")
    assert {r.chunk_id: r.removed_by for r in kept.collect()} == {"1": "missing", "2": "inactive", "3": "inactive"}


def test_scan_and_documents(spark, tmp_path):
    root = tmp_path / "build" / "repo"
    for name, data in {"a.py": b"x = 1\n", "b.py": b"\x00\x01", "c.md": b"\xff text", "node_modules/d.js": b"x", "e.bin": b"x", "f.py": b" \n", "s/g.go": b"package g"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    got = {r.file_path: r.content for r in src.scan(spark, f"file://{root}", "r").collect()}
    assert set(got) == {"a.py", "c.md", "s/g.go"} and got["c.md"].endswith(" text")
    stored = spark.createDataFrame([("r", "a.md", 1, "old")], "repository string, path string, version int, content string")
    new = spark.createDataFrame([("r", "a", "new"), ("r", "..\\b.md", "b"), ("r", "c", " ")], "repository string, title string, content string")
    after = src.document_versions(stored, new)
    assert {(r.path, r.version, r.previous) for r in src.with_previous(after).collect()} == {("a.md", 1, None), ("a.md", 2, "old"), ("b.md", 1, None)}
    assert src.document_versions(stored, new, overwrite=False).count() == 2
    assert [_one(spark, src.is_safe_path, p) for p in ("a/b.md", "../b.md", "/b.md", "b.txt", None)] == [True, False, False, False, False]


def test_logs(spark):
    path = new_path(spark, "log")
    rows = spark.createDataFrame([("t", "d", 1, 2.5, "sync", '{"a.md": 1.5}')], src.LOG)
    src.append_log(rows, path)
    src.append_log(rows, path)
    got = src.read_log(spark, path).collect()
    assert len(got) == 2 and got[0].scores == {"a.md": 1.5}
    latest = src.upsert_latest(spark.createDataFrame([("k", 1, "x")], "k string, v int, t string"), spark.createDataFrame([("k", 2, "y"), ("m", 1, "z")], "k string, v int, t string"), ["k"], "v")
    assert {tuple(r) for r in latest.collect()} == {("k", 2, "y"), ("m", 1, "z")}

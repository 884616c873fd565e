"""Sections, lookups, keywords, contexts, diffs, graph maintenance, walks, and the life of an index."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import search_terms
from lodestone.operators import changes, context, diffs, graph, keywords, lookups, quality, sections
from lodestone.operators.index import DimensionError, Index
from lodestone.session import new_path
from lodestone.sources.ledger import Ledger


def test_sections_stay_in_their_row(spark):
    docs = spark.createDataFrame([(1, "Intro\r\n\r\nTitle\n=====\nbody\n\nSub\n---\nmore\n"), (2, None), (3, "  \n"), (4, "<p>x</p>\n<H2 class='a'>A <b>b</b></H2>\ny")], "doc_id long, text string")
    got = {(r.doc_id, r.heading, r.start_line, r.end_line, r.content) for r in sections.rst_sections(docs.where("doc_id < 4")).collect()}
    assert got == {(1, None, 1, 1, "Intro"), (1, "Title", 3, 5, "Title\n=====\nbody"), (1, "Sub", 7, 9, "Sub\n---\nmore")}
    assert [(r.heading, r.start_line) for r in sections.html_sections(docs.where("doc_id = 4")).collect()] == [(None, 1), ("A b", 2)]
    for f in (sections.paragraphs, sections.markdown_sections, sections.rst_sections, sections.html_sections):
        assert "Exchange" not in f(docs)._jdf.queryExecution().toString()


def test_section_pieces():
    paragraphs = [f"p{i} x" + "x" * (i * 7 % 90) for i in range(60)]
    pieces = sections.section_pieces("\n\n".join(paragraphs), 50, 12)
    assert all(len(p) // 4 <= 50 for p in pieces)
    seen = [x for p in pieces for x in p.split("\n\n")]
    assert list(dict.fromkeys(seen)) == paragraphs and len(seen) > len(paragraphs)
    for a, b in zip(pieces, pieces[1:]):
        back = [x for x in b.split("\n\n") if x in a.split("\n\n")]
        assert len("\n\n".join(back)) // 4 <= 12
    assert sections.section_pieces("y" * 9000, 50, 12) == ["y" * 9000] and sections.section_pieces("a", 50, 0) == ["a"]


def test_lookups(spark):
    rows = [("c1", "f", "foo", "METHOD", "A", 1, 5, True), ("c2", "f", "bar", "function", None, 10, 20, True), ("c3", "g", "foo", "function", None, 1, 9, False), (None, "f", None, None, None, None, None, None)]
    s = spark.createDataFrame(rows, "chunk_id string, file_path string, symbol_name string, symbol_type string, parent_symbol string, start_line int, end_line int, active boolean")
    ids = lambda df: sorted(r.chunk_id for r in df.collect())
    assert ids(lookups.by_id(s, "c2")) == ["c2"] and ids(lookups.of_file(s, "f")) == ["c1", "c2"] and ids(lookups.named(s, "foo")) == ["c1", "c3"]
    assert ids(lookups.of_type(s, "Function")) == ["c2", "c3"] and ids(lookups.methods_of(s, "A")) == ["c1"]
    ranges = spark.createDataFrame([("f", 4, 6), ("f", 6, 8), ("f", 21, 20), ("g", 9, 9)], "file_path string, first_line int, last_line int")
    assert ids(lookups.overlapping(s, ranges, "file_path")) == ["c1", "c3"]
    assert ids(lookups.in_files(s, ranges.where("file_path = 'g'"))) == ["c3"]
    routes = spark.createDataFrame([("GET", "/a", 1, "llm"), ("GET", "/a", 0, "static"), ("PUT", "/a", 1, "llm")], "method string, route string, p int, source string")
    assert {(r.method, r.source) for r in lookups.first_of_each(routes, ["method", "route"], "p").collect()} == {("GET", "static"), ("PUT", "llm")}
    u = lookups.ordered_union(spark.createDataFrame([("k", 2, ["b", "a"]), ("k", 1, ["c", "a"]), ("k", 3, None)], "k string, o int, x array<string>"), ["k"], "o", "x")
    assert [r.x for r in u.collect()] == [["c", "a", "b"]]
    d = spark.createDataFrame([("a.b.Foo<T>(x)",)], "s string").select(lookups.described(F.col("s")).alias("s"))
    assert d.first().s == "Foo"
    assert lookups.distinct_drafts(s.unionByName(s).withColumn("content", F.lit("x")), "file_path").count() == 4


def test_keywords(spark):
    row = spark.createDataFrame([(["load user cache", "user cache refresh", "parse config tree", "the"], [["a1", "a2", "a3"], None, ["b1"]], ["Cache", "cache store", "store", "cache store index", "while", " "])], "p array<string>, l array<array<string>>, k array<string>")
    got = row.select(keywords.apart(F.col("p")).alias("apart"), keywords.interleaved(F.col("l")).alias("turns"), keywords.channel(F.col("k")).alias("channel"), keywords.longest_first(F.col("p")).alias("long"), keywords.expanded(F.lit("app.getUserName")).alias("e")).first()
    assert got.apart == ["load user cache", "parse config tree"] and got.turns == ["a1", "b1", "a2", "a3"]
    assert got.channel == ["cache", "cache store"] and got.long[0] == "load user cache" and got.e == ["app", "get", "getusername", "name", "user"]
    assert row.select(keywords.channel(F.lit(None).cast("array<string>")).alias("x")).first().x == []
    a = row.select(keywords.assembled(F.col("k"), F.array(F.lit("fooBar")), F.array(F.lit("queue one"), F.lit("topic two"))).alias("x")).first().x
    assert a == ["cache", "cache store", "fooBar", "queue one"]


def test_dependency_channel_and_retrieve(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    changed = spark.createDataFrame([(1, "a"), (2, "z")], "query_id long, file_path string")
    chunks = spark.createDataFrame([(f"{f}{i}", f, i, True) for f in "abcdz" for i in (2, 1)] + [("a9", "a", 9, False)], "chunk_id string, file_path string, start_line int, active boolean")
    hits = [(r.query_id, r.chunk_id, r.reason) for r in context.dependency_hits(edges, changed, chunks).orderBy("query_id", "rank").collect()]
    assert [h[1] for h in hits] == ["a1", "a2", "b1", "b2", "c1", "c2", "z1", "z2"] and hits[2][2] == "Dependency neighbor of a" and hits[0][2] == "Changed file"
    files = {(r.query_id, r.file_path) for r in context.dependency_files(edges, changed).collect()}
    assert files == {(1, "b"), (1, "c"), (2, "z")}
    one = spark.createDataFrame([(1, "x", 0.9, 1), (1, "y", 0.8, 2), (1, "w", 0.5, 3)], "query_id long, key string, score double, rank int")
    two = spark.createDataFrame([(1, "y", 1.0, 1)], "query_id long, key string, score double, rank int")

    def broken():
        raise RuntimeError("store is away")

    allowed = spark.createDataFrame([("y",), ("w",)], "key string")
    got = context.retrieve({"dense": lambda: one, "gone": broken, "keyword": lambda: two}, allowed, "key", 5).collect()
    assert [(r.key, r.rank) for r in sorted(got, key=lambda r: r.rank)] == [("y", 1), ("w", 2)]
    assert [r.key for r in context.retrieve({"dense": lambda: one}, None, "key", 1, rerank=lambda f, k: broken()).collect()] == ["x"]
    with pytest.raises(ValueError):
        context.retrieve({"gone": broken}, None, "key", 1)


def test_slices(spark):
    rows = [("c1", "src/api/a.py", "r", 1, 90), ("c2", "lib/src/api/A.py", "r", 2, 20), ("c3", "b.py", "Dependency neighbor of zed.py", 3, 5), ("c4", "src/x.py", "r", 4, 1)]
    hits = spark.createDataFrame(rows, "chunk_id string, file_path string, reason string, rank int, n int")
    targets = spark.createDataFrame([("./src/api/a.py",), ("zed.py",), ("nope.py",)], "target string")
    got = {(r.target, r.chunk_id) for r in context.file_slice(hits, targets, 100).collect()}
    assert got == {("./src/api/a.py", "c1"), ("zed.py", "c3")}
    modules = spark.createDataFrame([("src/",), ("src/api",), ("sr",)], "module string")
    assert {(r.module, r.chunk_id) for r in context.module_slice(hits, modules).collect()} == {("src/", "c1"), ("src/", "c4"), ("src/api", "c1")}
    text = spark.createDataFrame([(1, "f", 1, 2, "dense", 2, "B"), (1, "f", 3, 4, "dense", 1, "A")], "q int, file_path string, start_line int, end_line int, channel string, rank int, content string")
    assert context.context_text(text, "q").first().context == "[File: f | Lines: 3-4 | Source: dense | Rank: 1]\nA\n\n[File: f | Lines: 1-2 | Source: dense | Rank: 2]\nB"


def test_diff_texts(spark):
    diff = "--- a\n+++ b\n@@ -1,9 +1,9 @@\n" + "\n".join(f" l{i}" for i in range(6)) + "\n-old one\n-old two\n+new one\n+# note\n tail"
    pairs = spark.createDataFrame([("k", diff)], "key string, diff string")
    r = pairs.select(diffs.added_code(F.col("diff")).alias("a"), diffs.excerpt(F.col("diff"), 3).alias("e")).first()
    assert r.a == ["new one"] and r.e == ["-old one", "-old two", "+new one"]
    numbered = diffs.numbered_diff(pairs.withColumn("diff", F.regexp_replace("diff", "^--- a\n[+]{3} b\n", "")))
    shown = [(x.line.strip(), x.hidden) for x in diffs.near_changes(numbered).orderBy("position").collect()]
    assert shown[0] == ("l3", 3) and len(shown) == 8 and all(h == 0 for _, h in shown[1:])
    got = {(x.old_line, x.new_line, x.removed, x.added) for x in diffs.paired_changes(numbered).collect()}
    assert got == {(7, 7, "-old one", "+new one"), (8, 8, "-old two", "+# note")}


def test_change_signals(spark):
    kind = "array<struct<name:string>>"
    df = spark.createDataFrame([("moved into a package", [("helperOne",)], [], []), (None, [], [("x",)], []), ("poll the state", [], [("x",)], [])], f"d string, added_symbols {kind}, modified_symbols {kind}, removed_symbols {kind}")
    got = [tuple(r.x) for r in df.select(changes.diff_signals(F.col("d")).alias("x")).collect()]
    assert got == [(True, True, False, False), (False, False, False, False), (False, False, True, True)]


def test_graph_maintenance(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")], "src string, dst string")
    ch = spark.createDataFrame([("renamed", "B", "b"), ("deleted", "d", None), ("modified", "a", None), ("added", "n", None)], "change string, file_path string, old_path string")
    new = spark.createDataFrame([("a", "c"), ("n", "B"), ("n", "gone"), ("c", "a")], "src string, dst string")
    n, e = graph.updated(nodes, edges, ch, new)
    assert {r.node for r in n.collect()} == {"a", "B", "c", "n"} and {tuple(r) for r in e.collect()} == {("a", "c"), ("B", "c"), ("n", "B")}


def test_walks_and_cycles(spark):
    edges = spark.createDataFrame([("g", "a", "c"), ("g", "a", "b"), ("g", "b", "d"), ("g", "d", "a"), ("g", "c", "c"), ("h", "x", "y"), ("h", "y", "x")], "g string, src string, dst string")
    starts = spark.createDataFrame([("g", "a"), ("h", "nowhere")], "g string, start string")
    got = [(r.start, r.node) for r in graph.preorder(edges, starts, "g").orderBy("g", "position").collect()]
    assert got == [("a", "a"), ("a", "b"), ("a", "d"), ("a", "c"), ("nowhere", "nowhere")]
    assert [r.node for r in graph.preorder(edges, starts.where("g = 'g'"), "g", 1).orderBy("position").collect()] == ["a", "b", "c"]
    assert {(r.g, tuple(r.path)) for r in graph.cycles(edges, "g").collect()} == {("g", ("a", "b", "d", "a")), ("h", ("x", "y", "x"))}
    long = spark.createDataFrame([("l", f"n{i:05d}", f"n{(i + 1) % 3000:05d}") for i in range(3000)], "g string, src string, dst string")
    assert [len(r.path) for r in graph.cycles(long, "g").collect()] == [3001]
    with pytest.raises(graph.Unfinished):
        graph.reachable(edges.select("src", "dst"), spark.createDataFrame([("a", "d")], "seed string, node string"), most=1)
    n, e = graph.knowledge({"file": edges.select(F.col("src").alias("node")), "symbol": edges.select(F.col("dst").alias("node"))}, {"defines": edges})
    assert n.count() == 6 + 6 and e.count() == 7


def test_quality_routes_and_metrics(spark):
    df = spark.createDataFrame([(90.0, None, 0, None), (90.0, 40.0, 0, None), (70.6, None, 0, None), (70.6, None, 2, None), (60.0, None, 1, None), (60.0, None, 2, None), (90.0, None, 0, "x")], "s double, f double, c int, e string")
    v = df.withColumn("v", quality.status(F.col("s"), F.col("f"))).withColumn("r", quality.route(F.col("e"), F.col("v"), F.col("s"), F.col("c")))
    assert [(r.v, r.r) for r in v.collect()] == [("PASSED", "sync"), ("FAILED", "revision"), ("PASSED_WITH_WARNINGS", "revision"), ("PASSED_WITH_WARNINGS", "sync"), ("FAILED", "revision"), ("FAILED", "failed"), ("PASSED", "failed")]
    docs = spark.createDataFrame([("a", 80.04, None), (" ", 90.0, 50.0), (None, None, None)], "content string, quality double, faithfulness double")
    assert tuple(quality.run_metrics(docs, 10.0, 3, 7).first()) == (1, 85.0, 50.0, 10.0, 10.0, 0.4286)
    assert quality.run_metrics(docs.limit(0), 5.0, 1, 0).first().seconds_each == 0.0
    old = spark.createDataFrame([("# Log\n\n## one\n",), (None,)], "t string")
    assert [r.x for r in old.select(quality.prepended(F.col("t"), "# Log", F.lit("## two")).alias("x")).collect()] == ["# Log\n\n## two\n\n## one\n", "# Log\n\n## two"]
    found = spark.createDataFrame([("d", "error", "b"), ("d", "error", "a"), ("d", "error", "a")], "d string, level string, message string")
    assert [(r.n, r.messages) for r in quality.report(found, "d").collect()] == [(3, ["a", "b"])]


def _files(spark, rows):
    return spark.createDataFrame([("o/r", p, t) for p, t in rows], "repository string, file_path string, content string")


def test_life_of_an_index(spark):
    index = Index(Ledger(spark, new_path(spark, "index")))
    index.update(_files(spark, [("a.py", "def one():\n    return alpha\n"), ("b.py", "def two():\n    return beta\n"), ("c.md", "# Head\ngamma words\n"), ("d.md", "# Foot\nother words\n"), ("e.md", "more of these\n")]))
    asked = spark.createDataFrame([(1, "beta"), (2, "delta")], "query_id long, q string").select("query_id", search_terms(F.col("q")).alias("terms"))
    assert {r.query_id for r in index.search(asked).collect()} == {1} and index.differences().count() == 0
    before = index.table("vectors").count()
    index.update(_files(spark, [("b.py", "def two():\n    return delta\n")]), spark.createDataFrame([("o/r", "a.py")], "repository string, file_path string"))
    assert index.ledger.latest().info["change"] == "update" and {r.query_id for r in index.search(asked).collect()} == {2}
    s = index.statistics().first()
    assert (s.total, s.active, s.deleted, s.files) == (6, 4, 2, 4) and index.table("vectors").count() <= before
    index.compact()
    assert index.table("chunks").count() == 4
    ids = index.table("chunks").where("file_path = 'c.md'").select("chunk_id")
    index.delete(ids)
    assert index.statistics().first().deleted == 1 and index.differences().count() == 0
    bad = spark.createDataFrame([("k", [1.0, 2.0])], "cache_key string, vector array<float>")
    with pytest.raises(DimensionError):
        index.upsert(index.table("chunks"), bad)
    assert index.repair().info["change"] == "repair" and index.is_current
    index.model = {**index.model, "version": "other"}
    assert not index.is_current and index.update(_files(spark, [("b.py", "x = 1\n")])).info["change"] == "rebuild"
    index.delete_repository("o/r")
    assert index.table("chunks").count() == 0 and index.table("postings").count() == 0

import random

from pyspark.sql import functions as F

from lodestone.operators import chunking, embedding, symbols

OLD = '''class A:
    """Doc."""
    def keep(self, x):
        return x + 1  # note

    def old_name(self, value):
        total = 0
        for v in value:
            total += v * 2
        return total

def gone():
    pass
'''
NEW = '''class A:
    def keep(self, x):
        return x   +   1

    def new_name(self, value):
        total = 0
        for v in value:
            total += v * 2
        return total

async def fresh():
    return 1
'''


def test_tree_and_changes(spark):
    assert [(s[0], s[1], s[2], s[3]) for s in symbols.tree_symbols(OLD)] == [("A", "class", None, 1), ("keep", "method", "A", 3), ("old_name", "method", "A", 6), ("gone", "function", None, 12)]
    assert symbols.tree_symbols("def (") == symbols.tree_symbols(None) == []
    old, new = (symbols.python_symbols(spark.createDataFrame([("f.py", t), ("bad.py", "x ="), ("n.py", None)], "key string, text string"), "key", "text") for t in (OLD, NEW))
    got = {(r.name, r.change) for r in symbols.symbol_changes(old, new).collect()}
    assert got == {("A", "modified"), ("keep", "unchanged"), ("old_name", "deleted"), ("gone", "deleted"), ("new_name", "added"), ("fresh", "added")}
    pairs = [(r.name_from, r.name_to) for r in symbols.renamed_symbols(old, new).collect()]
    assert pairs == [("old_name", "new_name")]
    assert [r.name for r in symbols.longest_symbols(old, 2).orderBy("position").collect()] == ["A", "old_name"]


def test_lexical(spark):
    text = "import a, b\nfrom x.y import z\r\nconst f = require('./m')\nconst g = (a) => run(a)\nexport class K {}\n"
    df = spark.createDataFrame([("k", text), ("n", None), ("e", "")], "key string, text string")
    assert {r.module for r in symbols.imports(df, "key", "text").collect()} >= {"a", "b", "x.y", "./m"}
    assert {(r.kind, r.name) for r in symbols.definitions(df, "key", "text").collect()} == {("function", "g"), ("class", "K")}
    assert {(r.name, r.n) for r in symbols.calls(df, "key", "text").collect()} == {("require", 1), ("run", 1)}


def test_import_resolution(spark):
    files = spark.createDataFrame([("r", p) for p in ("app/main.py", "app/util.py", "app/pkg/__init__.py", "lib/deep/util.py", "web/x/index.ts")] + [("s", "app/util.py")], "repository string, file_path string")
    imp = spark.createDataFrame([("r", "app/main.py", m) for m in (".util", "app.pkg", "deep.util", "nothing", "..lib.deep.util", ".main", "web.x", "")], "repository string, file_path string, module string")
    got = {r.dst for r in symbols.import_edges(files, imp).collect()}
    assert got == {"app/util.py", "app/pkg/__init__.py", "lib/deep/util.py", "web/x/index.ts"}


def test_cut_lines_covers_everything():
    rng = random.Random(3)
    for _ in range(200):
        lines = ["x" * rng.choice([0, 3, 20, 60, 300]) for _ in range(rng.randrange(1, 60))]
        pieces = chunking.cut_lines(lines, 5, 40, 8)
        seen = set()
        for a, b, t in pieces:
            assert t == "\n".join(lines[a - 5 : b - 4])
            assert chunking.tokens(len(t)) <= 40 or a == b
            seen |= set(range(a, b + 1))
        assert seen == set(range(5, 5 + len(lines))) and [p[0] for p in pieces] == sorted(p[0] for p in pieces)


def test_chunked(spark):
    rows = [("r", "a.py", OLD), ("r", "b.md", "intro\n\n# One\ntext\n```\n# no heading\n```\n# Two\n\n"), ("r", "c.js", "// x\nfunction f() {\n  return 1\n}\nclass G {}\n"), ("r", "d.png", "x"), ("r", "e.py", None), ("r", "f.py", " \n"), ("r", "g.go", "y\n" * 5000)]
    df = chunking.chunked(spark.createDataFrame(rows, "repository string, file_path string, content string"))
    got = {}
    for r in df.collect():
        got.setdefault(r.file_path, []).append((r.symbol_name, r.symbol_type, r.start_line, r.end_line))
        assert r.token_count <= 1024 and r.content.strip()
    assert set(got) == {"a.py", "b.md", "c.js", "g.go"}
    assert sorted(got["a.py"], key=str) == sorted([("A", "class", 1, 10), ("keep", "method", 3, 4), ("old_name", "method", 6, 10), ("gone", "function", 12, 13)], key=str)
    assert [x[0] for x in sorted(got["b.md"], key=lambda x: x[2])] == [None, "One", "Two"]
    assert {x[0] for x in got["c.js"]} == {None, "f", "G"} and len(got["g.go"]) > 2


def test_embedding_cache(spark):
    rows = [("a", "alpha beta", "h1"), ("b", "alpha beta", "h1"), ("c", "gamma", "h2"), ("d", " ", "h3"), ("e", None, "h4")]
    df = spark.createDataFrame(rows, "chunk_id string, content string, content_hash string")
    vectors, cache = embedding.embedded(df)
    got = {r.chunk_id: r.vector for r in vectors.collect()}
    assert set(got) == {"a", "b", "c"} and got["a"] == got["b"] and len(got["a"]) == 64
    assert cache.count() == 2
    again, cache2 = embedding.embedded(df, cache)
    assert all(r.hit for r in again.collect()) and cache2.count() == 2
    assert embedding.purged(cache, df.where("chunk_id = 'c'")).count() == 1


def test_rerank(spark):
    hits = spark.createDataFrame([(1, 10, 1, "red blue", "none"), (1, 11, 2, "red blue", "Blue red"), (1, 12, 3, "red blue", None), (1, 13, 50, "red blue", "red blue")], "query_id long, key long, rank int, question string, content string")
    assert [r.key for r in embedding.reranked(hits, 2).orderBy("rank").collect()] == [11, 10]


def test_long_texts_are_embedded_whole(spark):
    text = "a b " * 10_000 + "other words at the end"
    df = spark.createDataFrame([("a", text, "h")], "chunk_id string, content string, content_hash string")
    want = embedding.HashingEmbedder().embed([text])[0]
    assert max(abs(x - y) for x, y in zip(embedding.embedded(df)[0].first().vector, want)) < 1e-6

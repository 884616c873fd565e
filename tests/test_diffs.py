import hashlib
import hmac

from pyspark.sql import functions as F

from lodestone.functions import responses as r
from lodestone.operators import changes, diffs


def _one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_file_changes(spark):
    make = lambda rows: spark.createDataFrame(rows, "file_path string, content string")
    old = make([("a", "1"), ("b", "2"), ("c", "3"), ("d", "same"), ("e", "same"), ("f", "keep")])
    new = make([("a", "1x"), ("b2", "2"), ("n", "new"), ("d2", "same"), ("f", "keep")])
    got = {tuple(x) for x in diffs.file_changes(old, new).collect()}
    assert got == {("a", None, "modified"), ("b2", "b", "renamed"), ("c", None, "deleted"), ("n", None, "added"), ("d2", "d", "renamed"), ("e", None, "deleted")}
    assert diffs.file_changes(old.limit(0), new.limit(0)).collect() == []


def test_unified_diffs_and_ranges(spark):
    old = "\n".join(f"l{i}" for i in range(1, 21))
    new = old.replace("l3\n", "l3\nnew\n").replace("l15\n", "")
    df = diffs.unified_diffs(spark.createDataFrame([("k", old, new), ("e", None, None)], "key string, old string, new string"))
    rows = {x.key: x for x in df.collect()}
    assert (rows["k"].added, rows["k"].removed, rows["e"].diff) == (1, 1, "")
    assert sorted((x.first_line, x.last_line) for x in changes.changed_lines(df).collect()) == [(4, 4), (16, 16)]
    numbered = {(x.kind, x.line): (x.old_line, x.new_line) for x in diffs.numbered_diff(df).collect()}
    assert numbered["added", "+new"] == (None, 4) and numbered["removed", "-l15"] == (15, None) and numbered["same", " l16"] == (16, 16)


def test_signatures(spark):
    good = "sha256=" + hmac.new(b"s", b"body", hashlib.sha256).hexdigest()
    df = spark.createDataFrame([("body", good), ("body", "sha256=0"), (None, good), ("body", None)], "b string, h string")
    assert [x.ok for x in df.select(diffs.signed("s", F.col("b"), F.col("h")).alias("ok")).collect()] == [True, False, False, False]
    assert all(x.ok for x in df.select(diffs.signed(None, F.col("b"), F.col("h")).alias("ok")).collect())


def test_answers(spark):
    text = "preamble\nSUMMARY: one\ntwo\n**APIS:**\n| Method | Route |\n|---|---|\n| POST | /webhook | x\nGRAPH:\n- API -> Service\nService ->\nScore: 140"
    df = spark.createDataFrame([(1, text), (2, None)], "k int, t string")
    got = {x.name: x.body for x in r.sections(df, "k", "t").collect()}
    assert got["SUMMARY"] == "one\ntwo" and set(got) == {"SUMMARY", "APIS", "GRAPH"}
    assert _one(spark, lambda c: r.table_rows(c, 2), got["APIS"]) == [["Method", "Route"], ["POST", "/webhook", "x"]]
    assert [tuple(e) for e in _one(spark, r.arrows, got["GRAPH"])] == [("API", "Service")]
    assert _one(spark, lambda c: r.score(c, "score"), text) == 100.0 and _one(spark, lambda c: r.score(c, "other"), text) is None


def test_changelogs_and_markdown(spark):
    log = "# C\n## [abc] msg\n**Author:** Alice  \n## [def] — t\n**Author:** Bob\n**Author:** Alice\n"
    assert _one(spark, r.changelog_commits, log) == 2 and _one(spark, r.changelog_authors, log) == ["Alice", "Bob"]
    assert _one(spark, r.numbered, ["a", "b"], "array<string>") == "1. a\n2. b" and _one(spark, r.bullets, [], "array<string>") == ""
    assert _one(spark, lambda c: r.table(["x", "y"], c), [["a|b", None]], "array<array<string>>") == "| x | y |\n| --- | --- |\n| a\\|b | - |"
    assert _one(spark, r.flowchart, [("a", "b")], "array<struct<src:string,dst:string>>") == "```mermaid\nflowchart TD\n    a --> b\n```"
    assert tuple(_one(spark, r.retrieval_parameters, 4, "int")) == (13, 0.02) and tuple(_one(spark, r.retrieval_parameters, 500, "int")) == (100, 0.0)
    assert _one(spark, lambda c: r.query_text([("Symbols", c), ("Files", F.array().cast("array<string>"))]), ["a", "b"], "array<string>") == "Symbols: a, b."

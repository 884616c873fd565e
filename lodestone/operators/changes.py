"""Changes of code: symbols, imports, commits, kinds of change, unified diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.files import DOC_EXTENSIONS, base_name, extension

#: Names and extensions of configuration files, and words in their names.
CONFIG_FILES = [
    "package.json", "package-lock.json", "requirements.txt", "pyproject.toml", "setup.py", "tsconfig.json", "dockerfile",
    "docker-compose.yml",
]
CONFIG_WORDS = ["config", "settings", "setup", "env", "properties"]
CONFIG_SUFFIXES = ["json", "yaml", "yml", "toml", "ini", "conf", "properties"]
#: Words in diffs and symbol names that hint at a kind of change.
HELPER_WORDS = ["helper", "util", "utility", "common", "shared", "internal", "private"]
#: Kinds of change, the one that names a commit's change first.
KIND_ORDER = [
    "structural_update", "added_helper", "code_organization", "refactor", "rename", "logic", "configuration", "documentation", "comment",
    "formatting",
]


def first_arrivals(code_changes: DataFrame, *columns: str) -> DataFrame:
    """Each change_no once, as it arrived first."""
    order = F.struct("recorded_at", "file_path")
    return code_changes.where("change_no is not null").groupBy("change_no").agg(F.min_by(F.struct(*columns), order).alias("x")).select("change_no", "x.*")


def symbol_histogram(changes: DataFrame) -> DataFrame:
    """(operation, symbol_type, n) over the added, modified and removed symbols."""
    sides = [changes.select(F.lit(op).alias("operation"), F.explode(f"{op}_symbols.symbol_type").alias("symbol_type")) for op in ("added", "modified", "removed")]
    return sides[0].unionByName(sides[1]).unionByName(sides[2]).groupBy("operation", "symbol_type").agg(F.count("*").alias("n"))


def import_deltas(changes: DataFrame) -> DataFrame:
    """(change_no, gained, lost): imports really gained and lost, sorted; what is both added and removed is neither."""
    gained = F.array_sort(F.array_except(F.coalesce("imports_added", F.array().cast("array<string>")), F.coalesce("imports_removed", F.array().cast("array<string>"))))
    lost = F.array_sort(F.array_except(F.coalesce("imports_removed", F.array().cast("array<string>")), F.coalesce("imports_added", F.array().cast("array<string>"))))
    return changes.select("change_no", gained.alias("gained"), lost.alias("lost"))


def _some(column: str) -> Column:
    return F.coalesce(F.size(column), F.lit(0)) > 0


def change_kind() -> Column:
    """The kind of a change by its file, its symbols and its summary; the first rule that holds decides.

    Rules in order: prose, configuration, renamed symbols, a pure move, nothing but whitespace in symbols and imports, a new helper, other
    added or removed symbols, modified symbols, logic.
    """
    name, ext = F.lower(base_name(F.col("file_path"))), extension(F.col("file_path"))
    added, modified, removed = (_some(f"{x}_symbols") for x in ("added", "modified", "removed"))
    imports = _some("imports_added") | _some("imports_removed")
    names = F.lower(F.concat_ws(" ", F.col("added_symbols.name"), F.col("modified_symbols.name"), F.col("removed_symbols.name"), F.coalesce("summary", F.lit(""))))
    config = name.isin(CONFIG_FILES) | ext.isin(CONFIG_SUFFIXES)
    for w in CONFIG_WORDS:
        config = config | name.contains(w)
    helper = F.lit(False)
    for w in HELPER_WORDS:
        helper = helper | names.contains(w)
    return (
        F.when(ext.isin(DOC_EXTENSIONS), "documentation")
        .when(config, "configuration")
        .when(_some("renamed_symbols"), "rename")
        .when((F.col("change_type") == "renamed") & ~added & ~modified & ~removed, "rename")
        .when(~added & ~modified & ~removed & ~imports, "logic")
        .when(helper & added & ~modified, "added_helper")
        .when(added | removed | modified, "structural_update")
        .otherwise("logic")
    )


def commit_kinds(changes: DataFrame) -> DataFrame:
    """(repository, current_commit, files, kind): the commit's kind is the one of its changes that comes first in KIND_ORDER."""
    rank = F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.col("kind"))
    return changes.withColumn("kind", change_kind()).groupBy("repository", "current_commit").agg(F.count_distinct("file_path").alias("files"), F.min_by("kind", rank).alias("kind"))


def pushed_files(pushes: DataFrame) -> DataFrame:
    """(delivery_no, operation, position, file_path): the files of a push, each once for each operation, in the order of their first mention."""
    each = pushes.select("delivery_no", F.posexplode("commits").alias("c", "commit"))
    sides = [each.select("delivery_no", F.lit(op).alias("operation"), "c", F.posexplode(f"commit.{op}").alias("f", "file_path")) for op in ("added", "modified", "removed")]
    rows = sides[0].unionByName(sides[1]).unionByName(sides[2])
    first = rows.groupBy("delivery_no", "operation", "file_path").agg(F.min(F.struct("c", "f")).alias("at"))
    order = W.partitionBy("delivery_no", "operation").orderBy("at")
    return first.select("delivery_no", "operation", F.row_number().over(order).alias("position"), "file_path")


def changed_lines(diffs: DataFrame, key: str = "key", diff: str = "diff") -> DataFrame:
    """(key, first_line, last_line): the ranges of new lines that a unified diff touches.

    A + line is the current new line, a - line the one at which it stood (1 at least); neighbouring lines make one range; a
    hunk without + and - counts with the range its header names. Each diff's lines are ordered by themselves.
    """
    lines = diffs.select(F.col(key).alias("key"), F.posexplode(F.split(F.col(diff), "\n")).alias("i", "line"))
    order = W.partitionBy("key").orderBy("i")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    header = F.col("line").rlike("^@@ .* @@")
    lines = lines.withColumn("hunk", F.sum(header.cast("int")).over(upto)).where("hunk > 0")
    start = F.regexp_extract("line", "\\+(\\d+)", 1)
    length = F.regexp_extract("line", "\\+\\d+,(\\d+)", 1)
    lines = lines.withColumns({"header": F.col("line").rlike("^@@ .* @@"), "start": F.when(F.col("line").rlike("^@@ "), start.try_cast("int")), "length": F.when(F.col("line").rlike("^@@ "), F.when(length == "", 1).otherwise(length.try_cast("int")))})
    inside = W.partitionBy("key", "hunk").orderBy("i")
    begin = F.first("start").over(inside.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    advances = (~F.col("header") & ~F.col("line").rlike("^[-\\\\]")).cast("int")
    before = F.coalesce(F.sum(advances).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    marked = lines.withColumn("new_line", F.greatest(F.lit(1), begin + before)).withColumn("mark", ~F.col("header") & F.col("line").rlike("^[+-]"))
    touched = marked.where("mark").select("key", "new_line").distinct()
    silent = marked.groupBy("key", "hunk").agg(F.count_if("mark").alias("marks"), F.max("start").alias("start"), F.max("length").alias("length")).where("marks = 0 and length > 0")
    touched = touched.unionByName(silent.select("key", F.explode(F.expr("sequence(start, start + length - 1)")).alias("new_line"))).distinct()
    island = F.col("new_line") - F.row_number().over(W.partitionBy("key").orderBy("new_line"))
    return touched.withColumn("island", island).groupBy("key", "island").agg(F.min("new_line").alias("first_line"), F.max("new_line").alias("last_line")).drop("island").withColumnRenamed("key", key)


#: Words in a diff that hint at a move, a refactoring, a change of behaviour.
ORGANIZATION_WORDS = [
    "reorganize", "reorganized", "reorganization", "organize", "organization", "move", "moved", "split", "split up", "extract", "relocate",
    "module", "package", "directory", "import order", "reorder import",
]
REFACTOR_WORDS = ["refactor", "refactored", "cleanup", "clean up", "simplify", "simplified", "consolidate", "consolidated", "extract helper", "deduplicate", "reduce duplication"]
BEHAVIOUR_WORDS = ["poll", "watch", "monitor", "callback", "invoke", "sync", "state", "login", "logout", "session", "identity", "track", "activity", "window"]


def _says(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def diff_signals(diff: Column) -> Column:
    """What the words of a diff and of the symbols hint at: struct(helper, organization, refactor, behavioral)."""
    text = F.lower(F.coalesce(diff, F.lit("")))
    names = F.lower(F.concat_ws(" ", F.col("added_symbols.name"), F.col("modified_symbols.name"), F.col("removed_symbols.name")))
    behavioral = _says(text, BEHAVIOUR_WORDS)
    helper = (_says(text, HELPER_WORDS) | _says(names, HELPER_WORDS)) & _some("added_symbols") & ~_some("modified_symbols")
    refactor = _says(text, REFACTOR_WORDS) | (_some("modified_symbols") & behavioral)
    return F.struct(helper.alias("helper"), _says(text, ORGANIZATION_WORDS).alias("organization"), refactor.alias("refactor"), behavioral.alias("behavioral"))


def keeps_structure(control_flow_changed: Column, calls_changed: Column, signature_changed: Column) -> Column:
    """Whether a change rewrites bodies only: symbols modified, none added or removed, imports alike, and none of the three signals."""
    bodies = _some("modified_symbols") & ~_some("added_symbols") & ~_some("removed_symbols") & ~_some("imports_added") & ~_some("imports_removed")
    return bodies & ~control_flow_changed & ~calls_changed & ~signature_changed

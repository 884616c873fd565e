"""What source files define, import and call: by patterns for all languages, by syntax tree for Python; and what changed.

The patterns run in the JVM, line by line; trees are built in Arrow batches, a file at a time. Null and blank sources define
nothing; sources that don't parse give no tree symbols.
"""

from __future__ import annotations

import ast
import difflib
import hashlib
import io
import tokenize
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.files import CODE_LANGUAGES, folder

#: Patterns of imports (what is imported in group 1), by which files without a syntax tree are read.
IMPORT_PATTERNS = [
    "\\bfrom\\s+['\"]([^'\"]+)['\"]",
    "\\bimport\\s+['\"]([^'\"]+)['\"]",
    "\\brequire\\s*\\(\\s*['\"]([^'\"]+)['\"]",
    "^\\s*from\\s+([A-Za-z0-9_./@-]+)\\s+import\\b",
    "^\\s*import\\s+([A-Za-z0-9_.,\\s/@-]+)",
]
#: Kinds of definition and their patterns (the name in group 1).
DEFINITION_PATTERNS = [(kind, f"\\b{kind}\\s+([A-Za-z_][A-Za-z0-9_]*)") for kind in ("class", "interface", "type", "enum", "struct", "trait")] + [
    ("function", "\\bfunction\\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("function", "\\bdef\\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("function", "\\b(?:const|let|var)\\s+([A-Za-z_][A-Za-z0-9_]*)\\s*=\\s*(?:async\\s*)?\\(?[^=]*?\\)?\\s*=>"),
]
CALL_PATTERN = "\\b([A-Za-z_][A-Za-z0-9_.]*)\\s*\\("
SYMBOLS = "key string, name string, symbol_type string, parent string, start_line int, end_line int, signature string, body string"


def _lines(files: DataFrame, key: str, text: str) -> DataFrame:
    t = F.regexp_replace(F.col(text), "\\r\\n?", "\n")
    return files.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.posexplode(F.split(t, "\n")).alias("at", "line")).select("key", (F.col("at") + 1).alias("line_no"), "line")


def definitions(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, name, line_no): the first match of each pattern on each line; two patterns that agree count once."""
    lines = _lines(files, key, text)
    found = F.array(*(F.struct(F.lit(kind).alias("kind"), F.regexp_extract("line", p, 1).alias("name")) for kind, p in DEFINITION_PATTERNS))
    return lines.select("key", "line_no", F.explode(found).alias("x")).where("x.name <> ''").select("key", "x.kind", "x.name", "line_no").distinct()


def imports(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, module): what a file imports, each once; lists are taken apart."""
    lines = _lines(files, key, text)
    found = F.flatten(F.array(*(F.regexp_extract_all("line", F.lit(p), F.lit(1)) for p in IMPORT_PATTERNS)))
    parts = lines.select("key", F.explode(found).alias("m")).select("key", F.explode(F.split("m", ",")).alias("m"))
    return parts.select("key", F.regexp_replace("m", "^\\s+|\\s+$", "").alias("module")).where("module <> ''").distinct()


def calls(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, n): how often something of that name is called."""
    lines = _lines(files, key, text)
    return lines.select("key", F.explode(F.regexp_extract_all("line", F.lit(CALL_PATTERN), F.lit(1))).alias("name")).groupBy("key", "name").agg(F.count("*").alias("n"))


def import_edges(files: DataFrame, imported: DataFrame) -> DataFrame:
    """(repository, src, dst): imports of (repository, file_path, module) resolved to files of the same repository.

    Dots become slashes, leading ones go up from the file's folder. The candidates are the path itself, with each code extension, and
    its index and __init__ file; of each candidate the file of exactly that path comes before files whose path ends with it, of
    several the first by name. All candidates of all imports meet all files in one equi-join, on paths and their endings.
    """
    spark = files.sparkSession
    endings = [f".{e}" for e in sorted(CODE_LANGUAGES)]
    tails = spark.createDataFrame([(i, t) for i, t in enumerate(["", *endings, *(x for e in endings for x in (f"/index{e}", f"/__init__{e}"))])], "rank int, tail string")
    dots = F.char_length(F.regexp_extract("module", "^(\\.*)", 1))
    plain = F.regexp_replace(F.regexp_replace("module", "^\\.+", ""), "\\.", "/")
    up = F.split(folder(F.col("file_path")), "/")
    base = F.array_join(F.slice(up, F.lit(1), F.greatest(F.lit(0), F.size(up) - dots + 1)), "/")
    path = F.when(dots == 0, plain).when(plain == "", base).otherwise(F.when(base == "", plain).otherwise(F.concat(base, F.lit("/"), plain)))
    asked = imported.select("repository", F.col("file_path").alias("src"), "module", path.alias("path")).where("path <> ''")
    candidates = asked.crossJoin(F.broadcast(tails)).select("repository", "src", "module", "rank", F.concat("path", "tail").alias("candidate"))
    parts = F.split("file_path", "/")
    ends = files.select("repository", "file_path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("depth", "candidate")).distinct()
    best = candidates.join(ends, ["repository", "candidate"]).groupBy("repository", "src", "module").agg(F.min_by("file_path", F.struct("rank", (F.col("depth") > 0), "file_path")).alias("dst"))
    return best.where("src <> dst").select("repository", "src", "dst").distinct()


def normalized_python(source: str) -> str:
    """Tokens without comments, docstrings and layout; the source itself, squeezed, where it can't be read."""
    out, fresh = [], True
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type in (tokenize.COMMENT, tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER):
                continue
            if t.type == tokenize.NEWLINE:
                fresh = True
                continue
            if t.type == tokenize.STRING and fresh:
                continue
            fresh = t.string == ":"
            out.append(t.string)
    except (tokenize.TokenError, SyntaxError, IndentationError):
        return " ".join(source.split())
    return " ".join(out)


def tree_symbols(source: str | None) -> list[tuple[str, str, str | None, int, int, str, str]]:
    """(name, type, parent, first line, last line, signature, source) of the classes, functions and methods of a Python source."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    lines, out = (source or "").splitlines(), []
    stack = [(node, None) for node in reversed(tree.body)]
    while stack:
        node, parent = stack.pop()
        if not isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        is_class = isinstance(node, ast.ClassDef)
        first, last = node.lineno, node.end_lineno or node.lineno
        kind = "class" if is_class else "method" if parent else "function"
        out.append((node.name, kind, parent, first, last, lines[first - 1].strip(), "\n".join(lines[first - 1 : last])))
        stack += [(child, node.name if is_class else parent) for child in reversed(node.body)]
    return out


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(key, *s) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for s in tree_symbols(text)]
        cols = list(zip(*rows)) if rows else [[]] * 8
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["key", "name", "symbol_type", "parent", "start_line", "end_line", "signature", "body"])


def python_symbols(files: DataFrame, key: str, text: str) -> DataFrame:
    return files.select(F.col(key).cast("string"), text).mapInArrow(_trees, SYMBOLS)


def _hashed(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: hashlib.sha256(normalized_python(b or "").encode()).hexdigest())


def symbol_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, name, symbol_type, parent, change) between two `python_symbols`: added, deleted, modified or unchanged by normal form.

    A symbol is told by file, parent, name and type; of several of one name the last counts.
    """
    normal = F.pandas_udf(_hashed, "string")

    def side(df: DataFrame, name: str) -> DataFrame:
        last = df.groupBy("key", "parent", "name", "symbol_type").agg(F.max_by("body", "start_line").alias("body"))
        return last.select("key", F.coalesce("parent", F.lit("")).alias("parent"), "name", "symbol_type", normal("body").alias(name))

    both = side(old, "o").join(side(new, "n"), ["key", "parent", "name", "symbol_type"], "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.col("o") != F.col("n"), "modified").otherwise("unchanged")
    return both.select("key", "name", "symbol_type", "parent", change.alias("change"))


def renamed_symbols(old: DataFrame, new: DataFrame, least: float = 0.9) -> DataFrame:
    """(key, name_from, name_to, similarity): deleted and added symbols of one file and type whose bodies, names masked, are nearly equal.

    Deleted symbols choose in the order of their lines, each the most similar one not yet taken. A file's symbols are one group.
    """
    gone = symbol_changes(old, new).where("change in ('added', 'deleted')")
    mark = lambda df, change: df.withColumn("parent", F.coalesce("parent", F.lit(""))).join(gone.where(F.col("change") == change).select("key", "parent", "name", "symbol_type"), ["key", "parent", "name", "symbol_type"], "left_semi").withColumn("side", F.lit(change))
    both = mark(old, "deleted").unionByName(mark(new, "added")).select("key", "side", "name", "symbol_type", "start_line", "body")

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_line", "name"], kind="stable")
        pdf["body"] = [" ".join("<symbol>" if t == n else t for t in normalized_python(b).split(" ")) for b, n in zip(pdf["body"], pdf["name"])]
        added, out = pdf[pdf["side"] == "added"], []
        taken: set[int] = set()
        for d in pdf[pdf["side"] == "deleted"].itertuples():
            best, at = least, None
            for a in added[added["symbol_type"] == d.symbol_type].itertuples():
                if a.Index in taken:
                    continue
                m = difflib.SequenceMatcher(None, d.body, a.body)
                if m.real_quick_ratio() >= best and (r := m.ratio()) >= best and (at is None or r > best):
                    best, at = r, a
            if at is not None:
                taken.add(at.Index)
                out.append((d.key, d.name, at.name, best))
        return pd.DataFrame(out, columns=["key", "name_from", "name_to", "similarity"])

    return both.groupBy("key").applyInPandas(pair, "key string, name_from string, name_to string, similarity double")


def longest_symbols(symbols: DataFrame, k: int = 50) -> DataFrame:
    """The k symbols of each file that span most lines, then by name."""
    order = W.partitionBy("key").orderBy((F.col("end_line") - F.col("start_line")).desc(), "name", "start_line")
    return symbols.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)

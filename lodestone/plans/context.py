"""Queries on sections, lookups, the dependency channel, filtered fusion, diffs, keywords and routing, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import changes as ch
from lodestone.operators import context, diffs, keywords, lookups, quality, sections
from lodestone.operators.chunks import newest
from lodestone.plans.changes import _FIRST
from lodestone.plans.search import ASKED, _BM25, _DENSE, _channels
from lodestone.plans.tables import _BLANK, _LINES, _STRIP
from lodestone.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_TRIM = r"regexp_replace(line, '^[\t-\r ]+|[\t-\r ]+$', '', 'g')"


def _by_heading(heading: str) -> str:
    return f"""WITH {_LINES}, h AS (SELECT *, {heading} AS heading FROM (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS below FROM l)),
    s AS (SELECT *, count(heading) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM h)
    SELECT * FROM (SELECT doc_id, max(heading) AS heading, min(CASE WHEN NOT {_BLANK} THEN line_no END) AS start_line, max(CASE WHEN NOT {_BLANK} THEN line_no END) AS end_line,
        {_STRIP} AS content FROM s GROUP BY doc_id, section) WHERE content <> ''"""


_UNDERLINED = r"""regexp_matches(regexp_replace(below, '^[\t-\r ]+|[\t-\r ]+$', '', 'g'), '^(=|-|`|:|~|''|"|\^|\+|\*){3,}$')"""


@_query(_by_heading(f"CASE WHEN {_TRIM} <> '' AND {_UNDERLINED} THEN {_TRIM} END"))
def rst_sections(spark: SparkSession, d: str) -> DataFrame:
    return sections.rst_sections(table(spark, d, "documents"))


@_query("SELECT * FROM (" + " UNION ALL ".join(_by_heading(rf"CASE WHEN regexp_matches({_TRIM}, '(?i)^<h{n}[^>]*>.*</h{n}>$') THEN regexp_replace(regexp_extract({_TRIM}, '(?i)^<h{n}[^>]*>(.*?)</h{n}>$', 1), '<[^>]+>', '', 'g') END") for n in (2,)) + ")")
def html_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of the documents as pages whose second-level headings are elements."""
    page = F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), "(?m)^##[ \t]+([^\n]*[^ \t\n])[ \t]*$", "<h2 class=\"x\">$1</h2>")
    return sections.html_sections(table(spark, d, "documents").select("doc_id", page.alias("text")))


SQL["html_sections"] = SQL["html_sections"].replace("FROM documents WHERE", r"""FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?m)^##[ \t]+([^\n]*[^ \t\n])[ \t]*$', '<h2 class="x">\1</h2>', 'g') AS text FROM documents) WHERE""")


@_query(r"""SELECT doc_id, CAST(count(*) AS BIGINT) AS parts, CAST(sum(length(p)) AS BIGINT) AS letters FROM (
        SELECT doc_id, regexp_replace(unnest(string_split_regex(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n[\t-\r ]*\n')), '^[\t-\r ]+|[\t-\r ]+$', '', 'g') AS p FROM documents WHERE text IS NOT NULL)
    WHERE p <> '' GROUP BY doc_id""")
def section_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts cut into pieces without overlap; what the pieces of a text hold is its paragraphs, each once."""
    each = sections.cut(table(spark, d, "documents"), lambda lines: iter([(None, 1, lines)]), limit=64, overlap=0)
    parts = F.filter(F.transform(F.split("content", "\n[\t-\r ]*\n"), lambda p: F.regexp_replace(p, "^[\t-\r ]+|[\t-\r ]+$", "")), lambda p: p != "")
    return each.select("doc_id", F.explode(parts).alias("p")).groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum(F.char_length("p")).alias("letters"))


_NOW = "now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC, active DESC, content_hash DESC) AS n FROM chunks WHERE chunk_id IS NOT NULL) WHERE n = 1)"


@_query(f"""WITH {_NOW}, r AS (SELECT repository, file_path, s.start_line AS a, s.end_line AS b FROM (SELECT repository, file_path, unnest(modified_symbols) AS s FROM {_FIRST}) WHERE s.start_line <= s.end_line
        UNION ALL SELECT repository, file_path, start_line, start_line + 2 FROM now WHERE symbol_name IS NULL)
    SELECT DISTINCT chunk_id, symbol_name FROM now JOIN r USING (repository, file_path) WHERE now.end_line >= a AND now.start_line <= b""")
def symbols_in_lines(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that meet the lines of modified symbols or the first lines of module chunks."""
    c = newest(table(spark, d, "chunks"), "repository", "file_path", "symbol_name", "start_line", "end_line")
    changed = ch.first_arrivals(table(spark, d, "code_changes"), "repository", "file_path", "modified_symbols")
    ranges = changed.select("repository", "file_path", F.explode("modified_symbols").alias("s")).select("repository", "file_path", F.col("s.start_line").alias("first_line"), F.col("s.end_line").alias("last_line"))
    ranges = ranges.unionByName(c.where("symbol_name is null").select("repository", "file_path", F.col("start_line").alias("first_line"), (F.col("start_line") + 2).alias("last_line")))
    return lookups.overlapping(c, ranges, "repository", "file_path").select("chunk_id", "symbol_name")


@_query(f"WITH {_NOW} SELECT repository, symbol_name, start_line, symbol_type, count(*) AS n FROM now GROUP BY ALL HAVING count(*) > 1")
def repeated_symbols(spark: SparkSession, d: str) -> DataFrame:
    c = newest(table(spark, d, "chunks"), "repository", "symbol_name", "start_line", "symbol_type")
    return lookups.repeated_symbols(c, "repository")


_FOLDER = "regexp_extract(file_path, '^(.*)/[^/]*$', 1)"
_HEADS = f"heads AS (SELECT repository, {_FOLDER} AS folder, min(file_path) AS file_path FROM now WHERE repository IS NOT NULL AND file_path IS NOT NULL GROUP BY ALL)"


def _heads(chunks: DataFrame) -> DataFrame:
    """(repository, folder, file_path): the first file of each folder."""
    folder = F.regexp_extract("file_path", "^(.*)/[^/]*$", 1)
    return chunks.where("repository is not null and file_path is not null").groupBy("repository", folder.alias("folder")).agg(F.min("file_path").alias("file_path"))


@_query(f"WITH {_NOW}, {_HEADS} SELECT chunk_id, file_path FROM now SEMI JOIN heads USING (repository, file_path) WHERE active")
def chunks_of_first_files(spark: SparkSession, d: str) -> DataFrame:
    c = newest(table(spark, d, "chunks"), "repository", "file_path", "active")
    return lookups.in_files(c.where("active"), _heads(c), "repository", "file_path").select("chunk_id", "file_path")


def _union(column: str) -> str:
    return f"""(SELECT repository, current_commit, string_agg(x, ',' ORDER BY o, i) AS {column} FROM (SELECT repository, current_commit, x, min(o) AS o, min_by(i, (o, i)) AS i FROM (
        SELECT repository, current_commit, change_no AS o, unnest({column}) AS x, generate_subscripts({column}, 1) AS i FROM {_FIRST}) GROUP BY repository, current_commit, x) GROUP BY ALL)"""


@_query(f"SELECT coalesce(a.repository, b.repository) AS repository, coalesce(a.current_commit, b.current_commit) AS current_commit, imports_added, imports_removed FROM {_union('imports_added')} a FULL JOIN {_union('imports_removed')} b ON a.repository = b.repository AND a.current_commit = b.current_commit")
def commit_imports(spark: SparkSession, d: str) -> DataFrame:
    c = ch.first_arrivals(table(spark, d, "code_changes"), "repository", "current_commit", "imports_added", "imports_removed")
    u = lookups.ordered_union(c, ["repository", "current_commit"], "change_no", "imports_added", "imports_removed")
    return u.select("repository", "current_commit", F.array_join("imports_added", ",").alias("imports_added"), F.array_join("imports_removed", ",").alias("imports_removed"))


_FILE = "repository || '/' || file_path"


@_query(f"""WITH {_NOW}, {_HEADS}, f AS (SELECT DISTINCT repository, {_FOLDER} AS folder, {_FILE} AS file FROM now WHERE repository IS NOT NULL AND file_path IS NOT NULL),
    e AS (SELECT file AS src, repository || '/' || file_path AS dst FROM f JOIN heads USING (repository, folder) WHERE file <> repository || '/' || file_path),
    near AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), q AS (SELECT repository AS query_id, max(file) AS file FROM f GROUP BY ALL),
    one AS (SELECT query_id, b AS file FROM q JOIN near ON file = a), two AS (SELECT query_id, b AS file FROM one JOIN near ON file = a),
    aff AS (SELECT query_id, file, max(c) AS is_changed FROM (SELECT query_id, file, 1 AS c FROM q UNION ALL SELECT query_id, file, 0 FROM one UNION ALL SELECT query_id, file, 0 FROM two) GROUP BY ALL),
    hits AS (SELECT query_id, chunk_id, file, start_line, is_changed FROM aff JOIN (SELECT *, {_FILE} AS file FROM now WHERE active) USING (file))
    SELECT query_id, chunk_id, file AS file_path, CASE WHEN is_changed = 1 THEN 'Changed file' ELSE 'Dependency neighbor of ' || seed END AS reason, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY file, start_line, chunk_id) AS rank FROM hits) JOIN (SELECT query_id, min(file) AS seed FROM q GROUP BY ALL) USING (query_id) WHERE rank <= 10""")
def dependency_hits(spark: SparkSession, d: str) -> DataFrame:
    """Files of a folder are neighbours of its first; each repository's last file is taken as changed."""
    file = F.concat("repository", F.lit("/"), "file_path")
    c = newest(table(spark, d, "chunks"), "repository", "file_path", "start_line", "active")
    files = c.where("repository is not null and file_path is not null").select("repository", F.regexp_extract("file_path", "^(.*)/[^/]*$", 1).alias("folder"), file.alias("file")).distinct()
    edges = files.join(_heads(c).withColumn("dst", file), ["repository", "folder"]).select(F.col("file").alias("src"), "dst").where("src <> dst")
    changed = files.groupBy(F.col("repository").alias("query_id")).agg(F.max("file").alias("file_path"))
    return context.dependency_hits(edges, changed, c.withColumn("file_path", file)).drop("score")


@_query(f"""WITH {_BM25}, {_DENSE}, ok AS (SELECT doc_id FROM documents WHERE lang = 'en'),
    u AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS rank, 0 AS c FROM (SELECT query_id // 20 AS query_id, id AS doc_id, score, rank FROM dense WHERE query_id < {20 * len(ASKED)}) SEMI JOIN ok USING (doc_id)
        UNION ALL SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id), 1 FROM (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) AS score, rank FROM bm25) SEMI JOIN ok USING (doc_id)),
    f AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS fused, max(score) AS score, arg_max(c, (score, -c)) AS c FROM u GROUP BY ALL)
    SELECT query_id, doc_id, round(fused, 6) AS fused, CASE c WHEN 0 THEN 'dense' ELSE 'keyword' END AS channel, rank FROM
    (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 12) DESC, score DESC, doc_id) AS rank FROM f) WHERE rank <= 5""")
def filtered_fusion(spark: SparkSession, d: str) -> DataFrame:
    """The whole search: channels, filter, fusion; English documents only."""
    channels = _channels(spark, d)
    allowed = table(spark, d, "documents").where("lang = 'en'").select("doc_id")
    got = context.retrieve({n: (lambda c=c: c) for n, c in channels.items()}, allowed, "doc_id", 5)
    return got.select("query_id", "doc_id", F.round("fused", 6).alias("fused"), "channel", "rank")


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    """A diff of each change's symbols: a hunk for each, with its name unchanged and its type added or removed."""
    c = ch.first_arrivals(table(spark, d, "code_changes"), "added_symbols", "removed_symbols")
    hunk = lambda sign: lambda s: F.concat(F.lit("@@ -"), s["start_line"], F.lit(",2 +"), s["start_line"], F.lit(",2 @@\n "), s["name"], F.lit(f"\n{sign}"), s["symbol_type"])
    return c.select(F.col("change_no").alias("key"), F.array_join(F.concat(F.transform("added_symbols", hunk("+")), F.transform("removed_symbols", hunk("-"))), "\n").alias("diff"))


_WHOLE = "lambda s: s.name IS NOT NULL AND s.symbol_type IS NOT NULL AND s.start_line IS NOT NULL"


@_query(f"""SELECT change_no AS key, array_to_string(list_transform(a, lambda s: s.symbol_type)[:80], ';') AS added,
    array_to_string(list_concat(list_transform(a, lambda s: '+' || s.symbol_type), list_transform(r, lambda s: '-' || s.symbol_type))[:8], ';') AS excerpt
    FROM (SELECT change_no, list_filter(added_symbols, {_WHOLE}) AS a, list_filter(removed_symbols, {_WHOLE}) AS r FROM {_FIRST})""")
def diff_excerpts(spark: SparkSession, d: str) -> DataFrame:
    return _diffs(spark, d).select("key", F.array_join(diffs.added_code(F.col("diff")), ";").alias("added"), F.array_join(diffs.excerpt(F.col("diff")), ";").alias("excerpt"))


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_SAYS = "lower(coalesce(summary, ''))"
_NAMES = "lower(array_to_string(list_concat(list_concat(list_transform(added_symbols, lambda s: s.name), list_transform(modified_symbols, lambda s: s.name)), list_transform(removed_symbols, lambda s: s.name)), ' '))"


@_query(f"""SELECT change_no, ({_any(_SAYS, ch.HELPER_WORDS)} OR {_any(_NAMES, ch.HELPER_WORDS)}) AND len(added_symbols) > 0 AND len(modified_symbols) = 0 AS helper, {_any(_SAYS, ch.ORGANIZATION_WORDS)} AS organization,
    {_any(_SAYS, ch.REFACTOR_WORDS)} OR (len(modified_symbols) > 0 AND {_any(_SAYS, ch.BEHAVIOUR_WORDS)}) AS refactor, {_any(_SAYS, ch.BEHAVIOUR_WORDS)} AS behavioral FROM {_FIRST}""")
def change_signals(spark: SparkSession, d: str) -> DataFrame:
    """What the summaries say, taken as diffs."""
    c = ch.first_arrivals(table(spark, d, "code_changes"), "summary", "added_symbols", "modified_symbols", "removed_symbols")
    return c.withColumn("x", ch.diff_signals(F.col("summary"))).select("change_no", "x.*")


@_query(f"""SELECT change_no, string_agg(name, ',' ORDER BY i, l) AS names FROM (
    SELECT change_no, 0 AS l, unnest(added_symbols).name AS name, generate_subscripts(added_symbols, 1) AS i FROM {_FIRST} UNION ALL SELECT change_no, 1, unnest(modified_symbols).name, generate_subscripts(modified_symbols, 1) FROM {_FIRST}
    UNION ALL SELECT change_no, 2, unnest(removed_symbols).name, generate_subscripts(removed_symbols, 1) FROM {_FIRST}) WHERE name IS NOT NULL GROUP BY change_no""")
def interleaved_symbols(spark: SparkSession, d: str) -> DataFrame:
    c = ch.first_arrivals(table(spark, d, "code_changes"), "added_symbols", "modified_symbols", "removed_symbols")
    turns = keywords.interleaved(F.array(*(F.col(f"{x}_symbols.name") for x in ("added", "modified", "removed"))))
    return c.select("change_no", F.array_join(turns, ",").alias("names"), F.size(turns).alias("n")).where("n > 0").drop("n")


@_query("""SELECT state_no, verdict, CASE WHEN coalesce(error_message, '') <> '' THEN 'failed' WHEN verdict = 'PASSED' THEN 'sync' WHEN verdict = 'PASSED_WITH_WARNINGS' THEN CASE WHEN score < 75 AND cycles < 2 THEN 'revision' ELSE 'sync' END
    WHEN cycles < 2 THEN 'revision' ELSE 'failed' END AS route FROM (SELECT *, rag_progress AS score, state_no % 4 AS cycles, CASE WHEN rag_progress >= 85 THEN 'PASSED' WHEN rag_progress >= 70 THEN 'PASSED_WITH_WARNINGS' ELSE 'FAILED' END AS verdict FROM workflow_states)""")
def route_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Progress stands for the score, the number of a state for its cycles."""
    w = table(spark, d, "workflow_states").withColumn("verdict", quality.status(F.col("rag_progress")))
    return w.select("state_no", "verdict", quality.route(F.col("error_message"), F.col("verdict"), F.col("rag_progress"), F.col("state_no") % 4).alias("route"))

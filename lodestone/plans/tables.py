"""Queries on chunk, file and document tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import files as fn
from lodestone.functions import ids, text, vectors
from lodestone.operators import chunks as ck
from lodestone.operators import profile, quality, sections
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


_TOKENS = "CASE WHEN length({0}) > 0 THEN greatest(1, length({0}) // 4) ELSE 0 END"
_NEWEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC, active DESC, content_hash DESC) AS newest FROM chunks) WHERE newest = 1)"
_FILES = f"(SELECT repository, file_path, CAST(sum(length(content)) AS BIGINT) AS size FROM {_NEWEST} GROUP BY ALL)"
_BASE = "regexp_extract({0}, '([^/]*)$', 1)"
_EXT = "lower(regexp_extract(regexp_extract({0}, '([^/]*)$', 1), '^.+\\.([^.]*)$', 1))"
_FOLDER = "regexp_replace({0}, '/?[^/]*$', '')"


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _case(values: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


@_query(f"""SELECT source, count(*) AS documents, CAST(sum({_TOKENS.format("text")}) AS BIGINT) AS tokens,
    CAST(sum(length(substring(text, 1, 400))) AS BIGINT) AS kept_chars, count_if({_TOKENS.format("text")} <= 256) AS fitting,
    CAST(sum(greatest(0, 8192 - {_TOKENS.format("text")})) AS BIGINT) AS left_over FROM documents GROUP BY source""")
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").groupBy("source").agg(
        F.count("*").alias("documents"),
        F.sum(text.estimate_tokens(t)).alias("tokens"),
        F.sum(F.char_length(text.truncate_tokens(t, 100))).alias("kept_chars"),
        F.count_if(text.fits(t, 256)).alias("fitting"),
        F.sum(text.available_tokens(8192, t)).alias("left_over"),
    )


@_query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[\t-\r ]+', ' ', 'g'), '^ | $', '', 'g') AS spaced,
    length(regexp_replace(text, '\r\n?', E'\n', 'g')) AS unix_length FROM documents WHERE text IS NOT NULL""")
def normal_space(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.normalize_space(t).alias("spaced"), F.char_length(text.unix_lines(t)).cast("long").alias("unix_length"))


@_query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def content_hash_copies(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", ids.content_hash(F.col("text")).alias("digest"))
    return rows.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@_query(f"""SELECT chunk_id, sha256(repository || ':' || file_path || ':' || coalesce(symbol_name, '__module__') || ':' || start_line || ':' || end_line || ':' || content_hash) AS identity,
    sha256(content_hash || ':hashing:1') AS cache_key FROM {_NEWEST}""")
def chunk_identity(spark: SparkSession, d: str) -> DataFrame:
    c = ck.newest(table(spark, d, "chunks"), "repository", "file_path", "symbol_name", "start_line", "end_line", "content_hash")
    identity = ids.chunk_id(*(F.col(x) for x in ("repository", "file_path", "symbol_name", "start_line", "end_line", "content_hash")))
    return c.select("chunk_id", identity.alias("identity"), ids.cache_key(F.col("content_hash"), "hashing", "1").alias("cache_key"))


@_query(f"SELECT repository, file_path, count(*) AS chunks, sha256(array_to_string(list_sort(list(content_hash)), '')) AS digest FROM {_NEWEST} GROUP BY ALL")
def file_digests(spark: SparkSession, d: str) -> DataFrame:
    return ck.file_digests(table(spark, d, "chunks"))


@_query(f"""SELECT repository, count(*) AS chunks, count_if(chunk_type = 'code') AS code_chunks, count_if(chunk_type = 'documentation') AS doc_chunks,
    count_if(chunk_type = 'code' AND symbol_name IS NULL) AS module_chunks, count_if(symbol_name IS NOT NULL) AS symbol_chunks,
    CAST(coalesce(sum(token_count), 0) AS BIGINT) AS tokens, count(DISTINCT file_path) AS files FROM {_NEWEST} GROUP BY repository""")
def chunk_statistics(spark: SparkSession, d: str) -> DataFrame:
    return ck.statistics(ck.newest(table(spark, d, "chunks"), "repository", "file_path", "chunk_type", "symbol_name", "token_count"), "repository")


@_query(r"""SELECT 'error' AS level, 'empty_content' AS code, count_if(regexp_matches(coalesce(content, ''), '^[\t-\r ]*$')) AS n FROM chunks
    UNION ALL SELECT 'error', 'bad_range', count_if(start_line < 1 OR end_line < start_line) FROM chunks
    UNION ALL SELECT 'warning', 'no_tokens', count_if(coalesce(token_count, 0) <= 0) FROM chunks
    UNION ALL SELECT 'error', 'duplicate_id', count(*) - count(DISTINCT chunk_id) FROM chunks""")
def chunk_violations(spark: SparkSession, d: str) -> DataFrame:
    return ck.violations(table(spark, d, "chunks"))


@_query(f"""SELECT removed_by, count(*) AS n FROM (SELECT CASE
        WHEN NOT coalesce(active, false) OR regexp_matches(content, '^[\\t-\\r ]*$') THEN 'inactive'
        WHEN NOT coalesce(lower(trim(prog_lang)) IN ('python', 'go', 'markdown'), false) THEN 'language'
        WHEN NOT coalesce(token_count >= 50, false) THEN 'similarity'
        WHEN NOT coalesce(chunk_type IN ('code'), false) THEN 'chunk_type'
        WHEN symbol_type IS DISTINCT FROM 'function' THEN 'symbol_type' END AS removed_by FROM {_NEWEST}) GROUP BY 1""")
def filter_chain_counts(spark: SparkSession, d: str) -> DataFrame:
    c = ck.newest(table(spark, d, "chunks"), "active", "content", "prog_lang", "token_count", "chunk_type", "symbol_type")
    kept = ck.filter_chain(c, languages=["Python", "go", "markdown"], score="token_count", threshold=50, chunk_types=["code"], symbol_type="function")
    return kept.groupBy("removed_by").agg(F.count("*").alias("n"))


@_query("""WITH r AS (SELECT DISTINCT repository, file_path, start_line, end_line FROM chunks WHERE start_line >= 1 AND end_line >= start_line),
    m AS (SELECT *, max(end_line) OVER (PARTITION BY repository, file_path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM r),
    i AS (SELECT *, sum(CASE WHEN reached IS NULL OR start_line > reached + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY repository, file_path ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT repository, file_path, min(start_line) AS first_line, max(end_line) AS last_line FROM i GROUP BY repository, file_path, island""")
def covered_lines(spark: SparkSession, d: str) -> DataFrame:
    return ck.covered_ranges(table(spark, d, "chunks"))


@_query("""WITH r AS (SELECT DISTINCT repository, file_path, start_line, end_line FROM chunks WHERE start_line >= 1 AND end_line >= start_line),
    m AS (SELECT *, coalesce(max(end_line) OVER (PARTITION BY repository, file_path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM r)
    SELECT repository, file_path, reached + 1 AS first_line, start_line - 1 AS last_line FROM m WHERE start_line > reached + 1""")
def uncovered_lines(spark: SparkSession, d: str) -> DataFrame:
    return ck.uncovered_ranges(table(spark, d, "chunks"))


@_query("""SELECT chunk_id, created_at, active, row_number() OVER w AS version, coalesce(CAST(lag(active) OVER w AS VARCHAR), 'none') AS was_active
    FROM (SELECT DISTINCT chunk_id, created_at, active FROM chunks) WINDOW w AS (PARTITION BY chunk_id ORDER BY created_at, active)""")
def chunk_history(spark: SparkSession, d: str) -> DataFrame:
    return ck.state_history(table(spark, d, "chunks")).withColumn("was_active", F.coalesce(F.col("was_active").cast("string"), F.lit("none")))


@_query(f"""SELECT f.repository, language, files, round(files / total * 100, 1) AS percentage FROM
    (SELECT repository, {_case(fn.PROFILE_LANGUAGES, _EXT.format("file_path"))} AS language, count(*) AS files FROM {_FILES} GROUP BY ALL) f
    JOIN (SELECT repository, count(*) AS total FROM {_FILES} GROUP BY ALL) t ON f.repository = t.repository WHERE language IS NOT NULL""")
def language_histogram(spark: SparkSession, d: str) -> DataFrame:
    return profile.language_histogram(profile.file_table(table(spark, d, "chunks")))


_CATEGORY = f"""CASE WHEN regexp_matches(lower({_BASE.format("file_path")}), 'test_|_test\\.|\\.test\\.|\\.spec\\.') THEN 'Test'
    WHEN {_EXT.format("file_path")} IN {_in(fn.SOURCE_EXTENSIONS)} THEN 'Source Code' WHEN {_EXT.format("file_path")} IN {_in(fn.DOC_EXTENSIONS)} THEN 'Documentation'
    WHEN {_BASE.format("file_path")} IN {_in(fn.CONFIG_NAMES)} OR {_EXT.format("file_path")} IN {_in(fn.CONFIG_EXTENSIONS)} THEN 'Configuration' ELSE 'Other' END"""


@_query(f"""SELECT repository, count(*) AS files, count(DISTINCT {_FOLDER.format("file_path")}) AS folders, count_if(c = 'Source Code') AS source_files, count_if(c = 'Test') AS test_files,
    count_if(c = 'Configuration') AS configuration_files, count_if(c = 'Documentation') AS documentation_files, arg_min(file_path, (-size, file_path)) AS largest_file, round(avg(size), 1) AS mean_size
    FROM (SELECT *, {_CATEGORY} AS c FROM {_FILES}) GROUP BY repository""")
def repository_statistics(spark: SparkSession, d: str) -> DataFrame:
    return profile.repository_statistics(profile.file_table(table(spark, d, "chunks")))


_KIND = "CASE WHEN folder = '' THEN 'Project Root' " + " ".join(f"WHEN lower(regexp_extract(folder, '([^/]*)$', 1)) IN {_in(names)} THEN '{kind}'" for kind, names in fn.FOLDER_KINDS.items()) + " ELSE 'Feature Module' END"


@_query(f"""SELECT repository, folder, kind, source_files, source_files >= 3 OR kind IN ('API', 'Authentication', 'Services', 'Database', 'RAG / AI', 'Feature Module', 'Application Layer', 'Infrastructure') AS has_module_doc
    FROM (SELECT repository, folder, {_KIND} AS kind, count_if(ext IN {_in([*fn.SOURCE_EXTENSIONS, "h", "sh"])}) AS source_files FROM
        (SELECT repository, {_FOLDER.format("file_path")} AS folder, {_EXT.format("file_path")} AS ext FROM {_FILES}) GROUP BY ALL)""")
def folder_kinds(spark: SparkSession, d: str) -> DataFrame:
    return profile.folders(profile.file_table(table(spark, d, "chunks")))


@_query(f"""SELECT r.repository, n.name, f.name IS NOT NULL AS present FROM (SELECT DISTINCT repository FROM {_FILES}) r CROSS JOIN (SELECT unnest([{", ".join("'" + n + "'" for n in fn.IMPORTANT_NAMES)}]) AS name) n
    LEFT JOIN (SELECT DISTINCT repository, {_BASE.format("file_path")} AS name FROM {_FILES}) f ON f.repository = r.repository AND f.name = n.name""")
def important_files(spark: SparkSession, d: str) -> DataFrame:
    return profile.known_files(profile.file_table(table(spark, d, "chunks")))


_RULES = ", ".join(f"('{n}', '{w}', '{f}')" for n, w, f in fn.FRAMEWORK_RULES)


@_query(f"""SELECT DISTINCT repository, framework FROM (SELECT repository, file_path, lower(substring(string_agg(content, chr(10) ORDER BY start_line, content), 1, 4096)) AS head
        FROM {_NEWEST} c WHERE content IS NOT NULL GROUP BY repository, file_path) JOIN (VALUES {_RULES}) r(name, word, framework)
    ON {_BASE.format("file_path")} = r.name AND contains(head, r.word)""")
def framework_rules(spark: SparkSession, d: str) -> DataFrame:
    return profile.frameworks(ck.newest(table(spark, d, "chunks"), "repository", "file_path", "start_line", "content"))


@_query(f"""WITH f AS (SELECT repository, {_FOLDER.format("file_path")} AS folder, {_BASE.format("file_path")} AS entry, true AS is_file FROM {_FILES}),
    d AS (SELECT DISTINCT repository, {_FOLDER.format("folder")} AS folder, {_BASE.format("folder")} AS entry, false AS is_file FROM f WHERE folder <> '')
    SELECT *, row_number() OVER (PARTITION BY repository, folder ORDER BY is_file, lower(entry), entry) AS position FROM (SELECT * FROM f UNION ALL SELECT * FROM d)""")
def directory_order(spark: SparkSession, d: str) -> DataFrame:
    return profile.sorted_directory(profile.file_table(table(spark, d, "chunks")))


_WORDS = "list_filter(string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace(symbol_name, '[^0-9A-Za-z]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), ' +'), lambda x: x <> '')"
_STOP = _in(sorted({*text.SYNTAX_WORDS, *text.PATH_WORDS, *text.WEAK_WORDS}))


@_query(f"""SELECT symbol_name, array_to_string(w, ' ') AS words, array_to_string(w, '') AS squashed, array_to_string(list_filter(w, lambda x: length(x) > 1 AND x NOT IN {_STOP}), ' ') AS telling,
    CAST(len(w) + greatest(0, len(w) - 1) + greatest(0, len(w) - 2) AS BIGINT) AS runs FROM (SELECT DISTINCT symbol_name, {_WORDS} AS w FROM chunks WHERE symbol_name IS NOT NULL)""")
def identifier_words(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("symbol_name")
    names = table(spark, d, "chunks").where("symbol_name is not null").select("symbol_name").distinct()
    w = text.identifier_words(s)
    count = F.size(w) + F.greatest(F.lit(0), F.size(w) - 1) + F.greatest(F.lit(0), F.size(w) - 2)
    return names.select("symbol_name", F.array_join(w, " ").alias("words"), F.array_join(w, "").alias("squashed"), F.array_join(text.telling_words(s), " ").alias("telling"), count.cast("long").alias("runs"))


@_query(f"""SELECT phrase, CAST(sum(CASE WHEN contains(phrase, ' ') THEN 3 ELSE 1 END) AS BIGINT) AS weight FROM (
    SELECT symbol_name, unnest(list_distinct(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])))) AS phrase
    FROM (SELECT DISTINCT symbol_name, list_filter({_WORDS}, lambda x: length(x) > 1 AND x NOT IN {_STOP}) AS t FROM chunks WHERE symbol_name IS NOT NULL)) GROUP BY phrase""")
def concept_counts(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "chunks").where("symbol_name is not null").select("symbol_name").distinct()
    each = names.select(F.explode(text.phrases(text.telling_words(F.col("symbol_name")))).alias("phrase"))
    return each.groupBy("phrase").agg(F.sum(F.when(F.col("phrase").contains(" "), 3).otherwise(1)).alias("weight"))


@_query("""SELECT DISTINCT repository, file_path, regexp_replace(repository, '[^A-Za-z0-9_\\-]', '_', 'g') AS slug,
    rtrim(replace(replace(base64(encode(file_path)), '+', '-'), '/', '_'), '=') AS document_id, file_path AS back FROM chunks""")
def slugs_and_ids(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "chunks").select("repository", "file_path").distinct()
    i = text.document_id(F.col("file_path"))
    return files.select("repository", "file_path", text.slug(F.col("repository")).alias("slug"), i.alias("document_id"), text.document_path(i).alias("back"))


_BLANK = "regexp_matches(line, '^[\\t-\\r ]*$')"
_LINES = """l AS (SELECT doc_id, CAST(generate_subscripts(x, 1) AS INTEGER) AS line_no, unnest(x) AS line FROM (SELECT doc_id,
    string_split(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n$', ''), chr(10)) AS x FROM documents WHERE length(text) > 0))"""
_STRIP = "regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '^[\\t-\\r ]+|[\\t-\\r ]+$', '', 'g')"


@_query(f"""WITH {_LINES}, s AS (SELECT *, sum(CASE WHEN {_BLANK} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM l)
    SELECT doc_id, min(line_no) AS start_line, max(line_no) AS end_line, {_STRIP} AS content FROM s WHERE NOT {_BLANK} GROUP BY doc_id, section""")
def paragraph_sections(spark: SparkSession, d: str) -> DataFrame:
    return sections.paragraphs(table(spark, d, "documents"))


@_query(f"""WITH {_LINES}, f AS (SELECT *, regexp_matches(line, '^[\\t-\\r ]*```') AS fence FROM l),
    g AS (SELECT *, sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS fences FROM f),
    h AS (SELECT *, CASE WHEN fences % 2 = 0 AND NOT fence AND regexp_matches(line, '^#{{1,6}}[\\t ]+[^\\t ]') THEN regexp_extract(line, '^#{{1,6}}[\\t ]+(.*)$', 1) END AS heading FROM g),
    s AS (SELECT *, count(heading) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM h)
    SELECT * FROM (SELECT doc_id, regexp_replace(max(heading), '^[\\t-\\r ]+|[\\t-\\r ]+$', '', 'g') AS heading, min(CASE WHEN NOT {_BLANK} THEN line_no END) AS start_line, max(CASE WHEN NOT {_BLANK} THEN line_no END) AS end_line,
        {_STRIP} AS content FROM s GROUP BY doc_id, section) WHERE content <> ''""")
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    return sections.markdown_sections(table(spark, d, "documents"))


@_query(r"""SELECT doc_id, len(regexp_extract_all(text, '(?m)^```')) AS fences, regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?m)[\t ]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')
    || CASE WHEN len(regexp_extract_all(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?m)^```')) % 2 = 1 THEN chr(10) || '```' ELSE '' END AS tidy FROM documents WHERE text IS NOT NULL""")
def tidy_markdown(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.fence_count(text.unix_lines(t)).cast("long").alias("fences"), text.tidy_markdown(t).alias("tidy"))


_QUALITY = r"""q AS (SELECT doc_id, lower(trim(source)) AS source, empty, CASE WHEN contains(file_path, '/') THEN CAST(NOT contains(t, '## overview') AS INT) + CAST(NOT contains(t, '## change summary') AS INT) + CAST(NOT contains(t, '## key components') AS INT)
        WHEN contains(t, '## ') THEN 0 ELSE CAST(NOT contains(t, '## overview') AS INT) END AS missing, CASE WHEN contains(file_path, '/') THEN 3 ELSE 1 END AS expected, fences, empty_headings,
        CASE WHEN empty THEN 0 ELSE CAST(fences % 2 <> 0 AS INT) + CAST(empty_headings > 0 AS INT) END AS warnings
    FROM (SELECT *, lower(coalesce(text, '')) AS t, regexp_matches(coalesce(text, ''), '^[\t-\r ]*$') AS empty, CAST(len(regexp_extract_all(coalesce(text, ''), '(?m)^```')) AS INT) AS fences,
        CAST(len(regexp_extract_all(coalesce(text, ''), '(?m)^#{1,6}[\t ]*$')) AS INT) AS empty_headings FROM documents)),
    s AS (SELECT *, CASE WHEN empty THEN 0.0 ELSE greatest(0.0, 100.0 - warnings * 5) END::DOUBLE AS formatting, CASE WHEN empty THEN 0.0 ELSE greatest(0.0, 100.0 - missing::DOUBLE / expected * 100) END::DOUBLE AS completeness,
        CASE WHEN empty THEN 0.0 ELSE 80.0 END::DOUBLE AS accuracy FROM q)"""


def _structure(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    scored = quality.structure(docs.select("doc_id", "file_path", "text", "source"), "doc_id", F.col("file_path"), "text")
    return scored.join(docs.select("doc_id", F.lower(F.trim("source")).alias("source")), "doc_id")


@_query(f"WITH {_QUALITY} SELECT doc_id, source, empty, missing, fences, empty_headings, warnings, formatting, round(completeness, 6) AS completeness, accuracy, round((formatting + completeness + accuracy) / 3, 1) AS score FROM s")
def document_structure(spark: SparkSession, d: str) -> DataFrame:
    return _structure(spark, d).withColumn("completeness", F.round("completeness", 6))


@_query(f"""WITH {_QUALITY} SELECT source, count(*) AS documents, CAST(sum(warnings) AS BIGINT) AS warnings,
    round(least((avg(completeness) * 0.25 + avg(accuracy) * 0.30 + 20.0 + avg(formatting) * 0.10 + greatest(0.0, 100.0 - sum(warnings) * 5) * 0.05) / 0.90, 100.0), 1) AS score FROM s GROUP BY source""")
def source_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.overall(_structure(spark, d), "source")


@_query("""SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm,
    round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) AS unit_sum FROM embeddings""")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    total = F.aggregate(vectors.l2_normalized(v), F.lit(0.0), lambda s, x: s + x)
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(v), 6).alias("norm"), F.round(total, 6).alias("unit_sum"))


@_query(r"""SELECT doc_id, len(regexp_extract_all(text, '(?m)^## \[[^\]\n]+\]')) AS commits, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?m)^\*\*Author:\*\*[ \t]*([^\r\n]*)', 1), lambda x: trim(x)))), ',') AS authors
    FROM documents WHERE lower(trim(source)) = 'changelog' AND text IS NOT NULL""")
def changelog_statistics(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.functions import responses

    t = F.col("text")
    logs = table(spark, d, "documents").where("lower(trim(source)) = 'changelog' and text is not null")
    return logs.select("doc_id", responses.changelog_commits(t).cast("long").alias("commits"), F.array_join(F.array_sort(responses.changelog_authors(t)), ",").alias("authors"))


#: The words issues are attributed by.
_KINDS = "class function method interface module enum struct section".split()


@_query(f"""SELECT doc_id, unnest(CASE WHEN len(k) > 0 THEN k ELSE ['unattributed'] END) AS kind FROM
    (SELECT doc_id, list_filter([{", ".join(repr(k) for k in _KINDS)}], lambda x: contains(lower(text), x)) AS k FROM documents WHERE text IS NOT NULL)""")
def attributed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the kinds of symbol they name; those that name none stay, as unattributed."""
    kinds = F.filter(F.array(*map(F.lit, _KINDS)), lambda k: F.lower("text").contains(k))
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", kinds.alias("k"))
    return docs.select("doc_id", F.explode(F.when(F.size("k") > 0, F.col("k")).otherwise(F.array(F.lit("unattributed")))).alias("kind"))

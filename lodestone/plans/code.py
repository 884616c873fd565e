"""Queries on source code: definitions, imports, calls, chunking, embedding, with SQL where patterns can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import chunking, embedding, retrieval, symbols
from lodestone.operators.chunks import newest
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


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_LINES = """now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC, active DESC, content_hash DESC) AS n FROM chunks) WHERE n = 1),
    l AS (SELECT key, CAST(generate_subscripts(x, 1) AS INTEGER) AS line_no, unnest(x) AS line FROM (SELECT chunk_id AS key, string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10)) AS x FROM now))"""


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return newest(table(spark, d, "chunks"), "repository", "file_path", "content")


@_query(f"WITH {_LINES} " + " UNION ".join(f"SELECT key, '{kind}' AS kind, regexp_extract(line, {_text(p)}, 1) AS name, line_no FROM l WHERE regexp_extract(line, {_text(p)}, 1) <> ''" for kind, p in symbols.DEFINITION_PATTERNS))
def symbol_definitions(spark: SparkSession, d: str) -> DataFrame:
    return symbols.definitions(_sources(spark, d), "chunk_id", "content")


@_query(f"WITH {_LINES}, m AS (" + " UNION ALL ".join(f"SELECT key, unnest(regexp_extract_all(line, {_text(p)}, 1)) AS m FROM l" for p in symbols.IMPORT_PATTERNS) + "), p AS (SELECT key, unnest(string_split(m, ',')) AS m FROM m) SELECT DISTINCT key, regexp_replace(m, '^\\s+|\\s+$', '', 'g') AS module FROM p WHERE regexp_replace(m, '^\\s+|\\s+$', '', 'g') <> ''")
def imported_modules(spark: SparkSession, d: str) -> DataFrame:
    return symbols.imports(_sources(spark, d), "chunk_id", "content")


@_query(f"WITH {_LINES} SELECT key, name, count(*) AS n FROM (SELECT key, unnest(regexp_extract_all(line, {_text(symbols.CALL_PATTERN)}, 1)) AS name FROM l) GROUP BY ALL")
def called_names(spark: SparkSession, d: str) -> DataFrame:
    return symbols.calls(_sources(spark, d), "chunk_id", "content")


@_query()
def python_definitions(spark: SparkSession, d: str) -> DataFrame:
    source = _sources(spark, d).where("file_path like '%.py'")
    return symbols.python_symbols(source, "chunk_id", "content").drop("body")


@_query()
def import_graph(spark: SparkSession, d: str) -> DataFrame:
    source = _sources(spark, d)
    found = symbols.imports(source, "chunk_id", "content").join(source.select(F.col("chunk_id").alias("key"), "repository", "file_path"), "key")
    return symbols.import_edges(source.select("repository", "file_path").distinct(), found)


@_query()
def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("repository is not null and file_path is not null")
    return chunking.chunked(docs.select("repository", F.concat("file_path", F.lit("."), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), F.col("text").alias("content")))


@_query()
def embedded_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks = newest(table(spark, d, "chunks"), "content", "content_hash")
    return embedding.embedded(chunks)[0].drop("hit")


@_query()
def reranked_hits(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.plans.search import ASKED, _asked

    docs = table(spark, d, "documents")
    hits = retrieval.bm25(docs, _asked(spark), k=40).select("query_id", F.col("doc_id").alias("key"), "rank")
    asked = spark.createDataFrame(list(enumerate(ASKED)), "query_id long, question string")
    return embedding.reranked(hits.join(F.broadcast(asked), "query_id").join(docs.select(F.col("doc_id").alias("key"), F.col("text").alias("content")), "key"), 10)

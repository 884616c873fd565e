"""The registered queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import credentials, encoding, handwritten, mixing, near_duplicates, similar_vectors, splitting, tokens
from lodestone.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_vectors.similar_pairs(table(spark, d, "chunks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.credentials(table(spark, d, "chunks"))


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redacted_chunks(table(spark, d, "chunks")).select("chunk_id", "redacted")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(table(spark, d, "chunks"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, d, "chunks"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "chunks"))


def p6_kinds(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.classified_files(table(spark, d, "chunks"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized_pieces(table(spark, d, "chunks")).where("piece_no = 0").select("chunk_id")


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized_pieces(table(spark, d, "chunks"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "source_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "source_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_documents(table(spark, d, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_documents(table(spark, d, "documents"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_redacted": p2_redacted, "p5_found": p5_found, "p5_classes": p5_classes, "p6_found": p6_found, "p6_kinds": p6_kinds, "p7_found": p7_found, "p7_pieces": p7_pieces, "p8_ids": p8_ids, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found, "p10_restored": p10_restored}

#: The three words of a run are told apart from other runs by the blanks between them, which words don't have.
_SHINGLES = """now AS (SELECT * FROM (SELECT chunk_id, content, row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC) AS n FROM chunks WHERE chunk_id IS NOT NULL AND content IS NOT NULL) WHERE n = 1),
    w AS (SELECT chunk_id, regexp_extract_all(lower(content), '[a-z0-9_]+') AS w FROM now),
    s AS (SELECT DISTINCT chunk_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT chunk_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) > 2)),
    size AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY chunk_id)"""

SQL = {
    "p5_found": f"""WITH {_SHINGLES}, common AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.chunk_id < b.chunk_id GROUP BY ALL)
        SELECT a AS chunk_id_a, b AS chunk_id_b FROM common JOIN size x ON x.chunk_id = a JOIN size y ON y.chunk_id = b WHERE c >= 0.6 * (x.n + y.n - c) - 1e-9""",
    "p7_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(content) // 4 > 1024",
}

"""Queries on retrieval, graphs and similarity, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text, vectors
from lodestone.operators import graph, retrieval
from lodestone.session import written
from lodestone.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The stated queries of the lexical channel.
ASKED = ["stale chunks retries", "compaction of embeddings pages", "keyword coverage section", "release notes changed files", "repository layer revision", "weak validation draft storage", "while the agent reads pages", "parsing parsing imports"]


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _asked(spark: SparkSession) -> DataFrame:
    q = spark.createDataFrame(list(enumerate(ASKED)), "query_id long, question string")
    return q.select("query_id", text.search_terms(F.col("question")).alias("terms"))


_VALUES = ", ".join(f"({i}, '{q}')" for i, q in enumerate(ASKED))
_BM25 = f"""terms AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+'), lambda x: lower(x))) AS term FROM documents),
    dl AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+')) AS dl FROM documents), tot AS (SELECT count(*) AS n, avg(dl) AS mean FROM dl),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    idf AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, tot), eps AS (SELECT 0.25 * avg(idf) AS eps FROM idf),
    q AS (SELECT id AS query_id, unnest(list_transform(regexp_extract_all(question, '[A-Za-z0-9_]+'), lambda x: lower(x))) AS term FROM (VALUES {_VALUES}) v(id, question)),
    bm AS (SELECT query_id, tf.doc_id, round(sum(CASE WHEN idf < 0 THEN eps ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 9) AS score FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), tot, eps GROUP BY ALL),
    bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm WHERE score > 0) WHERE rank <= 10)"""


@_query(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm25")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(table(spark, d, "documents"), _asked(spark)).withColumn("score", F.round("score", 6))


@_query(f"WITH {_BM25} SELECT term, df, round(CASE WHEN idf < 0 THEN eps ELSE idf END, 6) AS weight FROM idf JOIN df USING (term), eps WHERE df > 1")
def bm25_weights(spark: SparkSession, d: str) -> DataFrame:
    _, terms, totals = retrieval.lexical_index(table(spark, d, "documents"))
    weight = F.when(F.col("idf") < 0, F.col("mean_idf") * retrieval.EPSILON).otherwise(F.col("idf"))
    return terms.where("df > 1").crossJoin(F.broadcast(totals)).select("term", "df", F.round(weight, 6).alias("weight"))


_UNIT = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_DENSE = f"""dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM
    (SELECT a.vec_id AS query_id, b.vec_id AS id, {_UNIT} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)) WHERE rank <= 10)"""


def _dense(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.dense(v, v.where("id % 20 = 0"), k)


@_query(f"WITH {_DENSE} SELECT query_id, id, round(score, 6) AS score, rank FROM dense")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d).withColumn("score", F.round("score", 6))


@_query("""SELECT label, count(*) AS n, round(avg(list_cosine_similarity(embedding::DOUBLE[], c)), 6) AS mean_cosine FROM embeddings JOIN
    (SELECT label AS l, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY ALL) ON label = l GROUP BY label""")
def label_centroids(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centroids = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda y: y["m"]).alias("c"))
    return e.join(centroids, "label").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(vectors.cosine(F.col("embedding"), F.col("c"))), 6).alias("mean_cosine"))


def _channels(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    lexical = retrieval.bm25(table(spark, d, "documents"), _asked(spark))
    lexical = retrieval.normalized(lexical)
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    dense = retrieval.dense(v, v.where((F.col("id") % 20 == 0) & (F.col("id") < 20 * len(ASKED))), 10).select((F.col("query_id") / 20).cast("long").alias("query_id"), F.col("id").alias("doc_id"), "score", "rank")
    return {"dense": dense, "keyword": lexical}


@_query(f"""WITH {_BM25}, {_DENSE}, u AS (SELECT query_id // 20 AS query_id, id AS doc_id, score, rank, 0 AS c FROM dense WHERE query_id < {20 * len(ASKED)}
        UNION ALL SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id), rank, 1 FROM bm25),
    f AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS fused, max(score) AS score, arg_max(c, (score, -c)) AS c FROM u GROUP BY ALL)
    SELECT query_id, doc_id, round(fused, 6) AS fused, round(score, 6) AS score, CASE c WHEN 0 THEN 'dense' ELSE 'keyword' END AS channel, rank FROM
    (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 12) DESC, score DESC, doc_id) AS rank FROM f) WHERE rank <= 10""")
def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    fused = retrieval.fuse(_channels(spark, d), "doc_id", 10)
    return fused.select("query_id", "doc_id", F.round("fused", 6).alias("fused"), F.round("score", 6).alias("score"), "channel", "rank")


@_query("""SELECT source, doc_id, position, CAST(used AS BIGINT) AS used FROM (SELECT *, max(CASE WHEN used > 20000 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY position ROWS UNBOUNDED PRECEDING) AS over FROM (
    SELECT *, sum(n) OVER (PARTITION BY source ORDER BY position ROWS UNBOUNDED PRECEDING) AS used FROM (
    SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position FROM documents WHERE text IS NOT NULL AND source IS NOT NULL) WHERE position <= 30)) WHERE over = 0""")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "documents").where("text is not null and source is not null").select("source", "doc_id", F.char_length("text").alias("n"))
    return retrieval.within_budget(items, "source", "doc_id", "n", 20_000).select("source", "doc_id", "position", "used")


@_query()
def diversified(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    hits = _dense(spark, d, 20).join(e, "id").select("query_id", F.col("id").alias("key"), "rank", "vector")
    return retrieval.diversify(hits)


#: A graph over the star schema: nations point to regions, suppliers and customers to nations.
_EDGES = """(SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"""
_NODES = """(SELECT 'r' || r_regionkey AS node FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 's' || s_suppkey FROM supplier UNION ALL SELECT 'c' || c_custkey FROM customer UNION ALL SELECT 'p' || p_partkey FROM part)"""


def _node(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(_node("n", "n_nationkey").alias("src"), _node("r", "n_regionkey").alias("dst"))
    s = table(spark, d, "supplier").select(_node("s", "s_suppkey").alias("src"), _node("n", "s_nationkey").alias("dst"))
    c = table(spark, d, "customer").select(_node("c", "c_custkey").alias("src"), _node("n", "c_nationkey").alias("dst"))
    return n.unionByName(s).unionByName(c)


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    parts = [("r", "region", "r_regionkey"), ("n", "nation", "n_nationkey"), ("s", "supplier", "s_suppkey"), ("c", "customer", "c_custkey"), ("p", "part", "p_partkey")]
    out = None
    for prefix, name, column in parts:
        one = table(spark, d, name).select(_node(prefix, column).alias("node"))
        out = one if out is None else out.unionByName(one)
    return out


@_query(f"""WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM {_EDGES} UNION ALL SELECT dst, src FROM {_EDGES}),
    w(seed, node, distance) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION SELECT seed, b, distance + 1 FROM w JOIN e ON a = node WHERE distance < 2)
    SELECT seed, node, min(distance) AS distance FROM w GROUP BY ALL HAVING min(distance) > 0""")
def affected_within_two(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "region").select(_node("r", "r_regionkey").alias("seed"))
    return graph.within(_edges(spark, d), seeds, 2)


@_query(f"""WITH RECURSIVE w(seed, node) AS (SELECT 'c' || c_custkey, 'c' || c_custkey FROM customer UNION SELECT seed, dst FROM w JOIN {_EDGES} ON src = node)
    SELECT seed, 'r' || r_regionkey AS node, EXISTS (SELECT 1 FROM w WHERE w.seed = p.seed AND w.node = 'r' || r_regionkey) AS found FROM (SELECT 'c' || c_custkey AS seed FROM customer) p CROSS JOIN region""")
def path_exists(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "customer").select(_node("c", "c_custkey").alias("seed")).crossJoin(F.broadcast(table(spark, d, "region").select(_node("r", "r_regionkey").alias("node"))))
    return graph.reachable(_edges(spark, d), pairs)


@_query("""WITH n AS (SELECT 'n' || n_nationkey AS node, n_regionkey AS r FROM nation), m AS (SELECT 'r' || r_regionkey AS node, r_regionkey AS r FROM region UNION ALL SELECT node, r FROM n
        UNION ALL SELECT 's' || s_suppkey, r FROM supplier JOIN n ON node = 'n' || s_nationkey UNION ALL SELECT 'c' || c_custkey, r FROM customer JOIN n ON node = 'n' || c_nationkey)
    SELECT node, min(node) OVER (PARTITION BY r) AS component FROM m UNION ALL SELECT 'p' || p_partkey, 'p' || p_partkey FROM part""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(_nodes(spark, d), _edges(spark, d))


@_query(f"""SELECT count(*) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM {_EDGES} WHERE src <> dst)) AS edges,
    count_if(node NOT IN (SELECT src FROM {_EDGES} UNION ALL SELECT dst FROM {_EDGES})) AS isolated FROM {_NODES}""")
def graph_statistics(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _nodes(spark, d), _edges(spark, d)
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(graph.clean_edges(edges).agg(F.count("*").alias("edges"))).crossJoin(graph.isolated(nodes, edges).agg(F.count("*").alias("isolated")))


@_query(f"SELECT DISTINCT node FROM {_NODES} WHERE node IN (SELECT src FROM {_EDGES}) AND node NOT IN (SELECT dst FROM {_EDGES}) AND node NOT IN (SELECT 'c' || o_custkey FROM orders)")
def unreferenced_nodes(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "orders").select(_node("c", "o_custkey").alias("node"))
    return graph.unreferenced(_nodes(spark, d), _edges(spark, d), entries)


#: Files that changes renamed into one another.
_MOVES = "(SELECT repository || ':' || old_file_path AS src, repository || ':' || file_path AS dst FROM code_changes WHERE old_file_path IS NOT NULL)"


def _moves(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "code_changes").where("old_file_path is not null")
    name = lambda x: F.concat_ws(":", F.col("repository"), F.col(x))
    return c.select(name("old_file_path").alias("src"), name("file_path").alias("dst"))


@_query(f"""WITH n AS (SELECT DISTINCT repository || ':' || file_path AS node FROM chunks), e AS (SELECT * FROM {_MOVES})
    SELECT 'missing_end' AS fault, count(*) AS n FROM (SELECT DISTINCT src, dst FROM e WHERE src NOT IN (SELECT node FROM n) OR dst NOT IN (SELECT node FROM n))
    UNION ALL SELECT 'self_loop', count(*) FROM e WHERE src = dst UNION ALL SELECT 'repeat', count(*) - (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM e)) FROM e""")
def edge_faults(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "chunks").select(F.concat_ws(":", "repository", "file_path").alias("node"))
    return graph.edge_faults(nodes, _moves(spark, d))


#: Which nation's suppliers deliver to which nation's customers: a dense little graph with cycles.
@_query("""WITH e AS (SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE s_nationkey <> c_nationkey)
    SELECT x.src AS a, x.dst AS b, CAST(-1 AS INTEGER) AS c FROM e x JOIN e y ON y.src = x.dst AND y.dst = x.src WHERE x.src < x.dst
    UNION ALL SELECT x.src, x.dst, y.dst FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = y.dst AND z.dst = x.src WHERE x.src < x.dst AND x.src < y.dst AND y.dst <> x.dst""")
def short_cycles(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(s, "l_suppkey").select("l_orderkey", "src").distinct()
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(c, "o_custkey").select("l_orderkey", "dst")
    edges = written(lines.join(orders, "l_orderkey").select("src", "dst").distinct(), "nations")
    return graph.short_cycles(edges).withColumn("c", F.coalesce("c", F.lit(-1)))

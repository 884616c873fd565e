"""Lexical, dense and fused retrieval for many queries at once, and what follows a ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import search_terms
from lodestone.session import written

K1, B, EPSILON, RRF = 1.5, 0.75, 0.25, 60
_BLOCK = 4096


def postings(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, dl): how often a term stands in a document and how many terms that has."""
    terms = documents.select(F.col(key).alias("key"), search_terms(F.col(text)).alias("terms"))
    return terms.select("key", F.size("terms").alias("dl"), F.explode("terms").alias("term")).groupBy("key", "dl", "term").agg(F.count("*").alias("tf"))


def lexical_index(documents: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, terms (term, df, idf), totals (docs, mean_dl, mean_idf) in one row), written once; any number of searches reads them.

    The texts are read once, by the postings; how many documents there are needs no column.
    """
    p = written(postings(documents, key, text), "postings")
    totals = documents.agg(F.count("*").alias("docs")).crossJoin(p.agg(F.sum("tf").alias("words"))).select("docs", (F.col("words") / F.col("docs")).alias("mean_dl"))
    df = p.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(totals))  # one row
    terms = written(df.select("term", "df", (F.ln(F.col("docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("idf")), "terms")
    return p, terms, totals.crossJoin(terms.agg(F.avg("idf").alias("mean_idf")))


def bm25(documents: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", k: int = 10) -> DataFrame:
    """Searches a new index of the documents, see `search`."""
    return search(lexical_index(documents, key, text), queries, key, k)


def search(index: tuple[DataFrame, DataFrame, DataFrame], queries: DataFrame, key: str = "doc_id", k: int = 10) -> DataFrame:
    """(query_id, key, score, rank): the k best documents of each query, by score (to nine places, as the order of adding shows beyond) and then key; scores of 0 or less don't count.

    queries has query_id and terms, an array in which a repeated term counts again. Postings meet the terms asked for by a join, which
    the optimizer makes a broadcast only if they are few.
    A term's weight is ln(N - df + 0.5) - ln(df + 0.5); where that is negative, EPSILON times the mean weight of all terms.
    Documents without any term count in N and in the mean length.
    """
    p, terms, totals = index
    asked = queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    weighted = terms.join(asked, "term").crossJoin(F.broadcast(totals))  # one row
    weighted = weighted.withColumn("idf", F.when(F.col("idf") < 0, F.col("mean_idf") * EPSILON).otherwise(F.col("idf")))
    tf = F.col("tf")
    part = F.col("qf") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("mean_dl")))
    scored = p.join(weighted, "term").groupBy("query_id", F.col("key").alias(key)).agg(F.round(F.sum(part), 9).alias("score")).where("score > 0")
    return ranked(scored, "query_id", key, k)


def normalized(hits: DataFrame) -> DataFrame:
    """hits (query_id, score, ...) with each query's scores over its best; a query has k rows at most."""
    return hits.withColumn("score", F.col("score") / F.max("score").over(W.partitionBy("query_id")))


def ranked(scored: DataFrame, group: str, key: str, k: int, score: str = "score") -> DataFrame:
    order = W.partitionBy(group).orderBy(F.col(score).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), pa.array([part.column(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()]), pa.array([x.tobytes()])], names=["n", "ids", "vectors"])

    return run


def _best(k: int):
    def unit(data: bytes, n: int) -> np.ndarray:
        x = np.frombuffer(data, np.float32).reshape(n, -1).astype(np.float64)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, v = unit(row["q_vectors"], row["q_n"]), unit(row["vectors"], row["n"])
                qi, vi = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                s = q @ v.T
                s[qi[:, None] == vi[None, :]] = -9
                m = min(k, s.shape[1])
                top = np.argpartition(-s, m - 1, 1)[:, :m]
                # Ties at the edge go by id, so everything as good as the worst kept counts.
                edge = np.take_along_axis(s, top, 1).min(1)
                r, c = np.nonzero((s >= edge[:, None]) & (s > -9))
                yield pa.RecordBatch.from_arrays([pa.array(qi[r]), pa.array(vi[c]), pa.array(s[r, c])], names=["query_id", "id", "score"])

    return run


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10, threshold: float | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k nearest of (id, vector) by cosine for each of (id, vector), itself left out, exactly.

    Both sides are packed into blocks of rows, and each pair of blocks is one matrix product whose best k a query go on; all
    vectors have one length.
    """
    rows, asked = (d.select("id", "vector").mapInArrow(_blocks(_BLOCK), "n int, ids binary, vectors binary") for d in (vectors, queries))
    pairs = asked.select(F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")).crossJoin(rows)
    scored = pairs.mapInArrow(_best(k), "query_id long, id long, score double")
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return ranked(scored, "query_id", "id", k)


def fuse(channels: dict[str, DataFrame], key: str, k: int, constant: int = RRF) -> DataFrame:
    """(query_id, key, fused, score, channel, rank): reciprocal rank fusion of ranked lists (query_id, key, score, rank).

    The row keeps the greatest score of any channel and its name, of equal ones the channel named first; ties in the fused
    score go by score and then key.
    """
    names = list(channels)
    union = None
    for i, name in enumerate(names):
        c = channels[name].select("query_id", key, "score", "rank", F.lit(i).alias("c"))
        union = c if union is None else union.unionByName(c)
    best = F.max(F.struct("score", -F.col("c")))
    fused = union.groupBy("query_id", key).agg(F.sum(1.0 / (constant + F.col("rank"))).alias("fused"), best.alias("best"))
    named = F.element_at(F.array(*map(F.lit, names)), 1 - F.col("best.col2"))
    fused = fused.select("query_id", key, "fused", F.col("best.score").alias("score"), named.alias("channel"))
    order = W.partitionBy("query_id").orderBy(F.round("fused", 12).desc(), F.col("score").desc(), F.col(key))
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def within_budget(items: DataFrame, group: str, order: str, length: str, budget: int, most: int = 30) -> DataFrame:
    """The first `most` items of each group, up to the first that would overrun the budget. Each group is cut to `most` before anything is summed."""
    w = W.partitionBy(group).orderBy(order)
    head = items.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)
    running = F.sum(length).over(W.partitionBy(group).orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow))
    head = head.withColumn("used", running)
    over = F.max(F.when(F.col("used") > budget, 1).otherwise(0)).over(W.partitionBy(group).orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow))
    return head.withColumn("over", over).where("over = 0").drop("over")


def diversify(items: DataFrame, weight: float = 0.7) -> DataFrame:
    """Maximal marginal relevance over (query_id, key, rank, vector): `new_rank` trades rank against likeness to what was chosen.

    The first stays first; an item's relevance is 1 - i / n on its 0-based position; of equal ones the earlier wins; if a vector of
    the group is missing, the order stays. Groups are result lists, at most a few dozen items.
    """

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable").reset_index(drop=True)
        n = len(pdf)
        if n > 2 and pdf["vector"].notna().all() and len({len(v) for v in pdf["vector"]}) == 1:
            x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            relevance, near = 1 - np.arange(n) / n, np.full(n, -np.inf)
            left, chosen = list(range(1, n)), [0]
            while left:
                near = np.maximum(near, x @ x[chosen[-1]])
                at = max(left, key=lambda i: (weight * relevance[i] - (1 - weight) * near[i], -i))
                chosen.append(at)
                left.remove(at)
            pdf = pdf.iloc[chosen]
        return pd.DataFrame({"query_id": pdf["query_id"], "key": pdf["key"], "rank": pdf["rank"], "new_rank": np.arange(1, n + 1, dtype=np.int32)})

    return items.select("query_id", "key", "rank", "vector").groupBy("query_id").applyInPandas(order, "query_id long, key long, rank int, new_rank int")

"""The life of an index: built from files, kept up with changes, rebuilt when the model changes, repaired, and dropped by repository.

A version is one folder of the ledger with three tables: `chunks` (with their state), `vectors` (cache_key, vector) and `postings`. A
change writes the tables that follow from it and commits them together; a run that dies leaves the version before.

Defined results
- an update with files of other contents replaces these files' chunks; chunks of a touched file that are gone stay as inactive rows
- a vector is made once for each content, model and version; vectors of other lengths than the model's are an error
- an update under another model or version is a rebuild; without an index it is the first build
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.ids import cache_key
from lodestone.operators import chunking, embedding, retrieval, snapshots
from lodestone.sources.ledger import Commit, Ledger

_COLUMNS = ["chunk_id", "repository", "file_path", "prog_lang", "chunk_type", "symbol_name", "symbol_type", "parent_symbol", "start_line", "end_line", "content", "content_hash", "token_count", "active"]


class DimensionError(ValueError):
    """A vector's length isn't the model's."""


class Index:
    def __init__(self, ledger: Ledger, make: Callable[[], embedding.Embedder] = embedding.HashingEmbedder):
        self.ledger, self.make = ledger, make
        e = make()
        self.model = {"name": e.name, "version": e.version, "dimension": e.dimension}

    def table(self, name: str) -> DataFrame | None:
        commit = self.ledger.latest()
        return self.ledger.part(commit, name) if commit and commit.data else None

    @property
    def is_current(self) -> bool:
        """Whether there is an index and this model made it."""
        commit = self.ledger.latest()
        return commit is not None and commit.info.get("model") == self.model

    def build(self, files: DataFrame) -> Commit:
        """A new index of (repository, file_path, content); what was before is replaced."""
        return self._commit(chunking.chunked(files).select(_COLUMNS).dropDuplicates(["chunk_id"]), None, "build")

    def update(self, files: DataFrame, deleted: DataFrame | None = None) -> Commit:
        """Takes in changed files (repository, file_path, content) and deleted ones (repository, file_path); the others stay."""
        old = self.table("chunks")
        new = chunking.chunked(files).select(_COLUMNS).dropDuplicates(["chunk_id"])
        if old is None:
            return self._commit(new, None, "build")
        touched = files.select("repository", "file_path")
        if deleted is not None:
            touched = touched.unionByName(deleted.select("repository", "file_path"))
        touched = touched.distinct()
        gone = old.join(touched, ["repository", "file_path"], "left_semi").join(new.select("chunk_id"), "chunk_id", "left_anti").withColumn("active", F.lit(False))
        rest = old.join(touched, ["repository", "file_path"], "left_anti").join(new.select("chunk_id"), "chunk_id", "left_anti")
        chunks = rest.select(_COLUMNS).unionByName(gone.select(_COLUMNS)).unionByName(new)
        return self._commit(chunks, self.table("vectors") if self.is_current else None, "update" if self.is_current else "rebuild")

    def upsert(self, chunks: DataFrame, vectors: DataFrame | None = None) -> Commit:
        """Chunk rows win over those of equal chunk_id; vectors (cache_key, vector) given with them are taken if their length is the model's."""
        chunks = chunks.select(_COLUMNS).dropDuplicates(["chunk_id"])
        if vectors is not None and not vectors.where(F.size("vector") != self.model["dimension"]).isEmpty():
            raise DimensionError(f"vectors must have {self.model['dimension']} components")
        old, cache = self.table("chunks"), self.table("vectors") if self.is_current else None
        rows = chunks if old is None else old.select(_COLUMNS).join(chunks.select("chunk_id"), "chunk_id", "left_anti").unionByName(chunks)
        if vectors is not None:
            own = vectors.select("cache_key", "vector").dropDuplicates(["cache_key"])
            cache = own if cache is None else cache.join(own, "cache_key", "left_anti").unionByName(own)
        return self._commit(rows, cache, "upsert")

    def delete(self, ids: DataFrame, hard: bool = False) -> Commit:
        """Makes chunks inactive, or drops them."""
        old = self.table("chunks")
        kept = old.join(ids.select("chunk_id").distinct(), "chunk_id", "left_anti")
        if not hard:
            kept = kept.unionByName(old.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi").withColumn("active", F.lit(False)))
        return self._commit(kept.select(_COLUMNS), self.table("vectors"), "delete")

    def delete_repository(self, name: str) -> Commit:
        return self._commit(self.table("chunks").where(~F.col("repository").eqNullSafe(F.lit(name))), self.table("vectors"), "delete_repository")

    def compact(self, least: float = 0.25) -> Commit:
        """Drops the inactive rows of the repositories of which that much is inactive."""
        return self._commit(snapshots.compacted(self.table("chunks"), least).select(_COLUMNS), self.table("vectors"), "compact")

    def differences(self) -> DataFrame:
        """(chunk_id, only_in): active chunks without vector (left); postings of chunks that aren't active (right)."""
        e = self.make()
        active = self.table("chunks").where("active").withColumn("cache_key", cache_key(F.col("content_hash"), e.name, e.version))
        without = active.join(self.table("vectors"), "cache_key", "left_anti").select("chunk_id", F.lit("left").alias("only_in"))
        extra = self.table("postings").select(F.col("key").alias("chunk_id")).distinct().join(active, "chunk_id", "left_anti").select("chunk_id", F.lit("right").alias("only_in"))
        return without.unionByName(extra)

    def repair(self) -> Commit:
        """Makes vectors and postings anew where they don't follow from the chunks."""
        return self._commit(self.table("chunks"), self.table("vectors") if self.is_current else None, "repair")

    def statistics(self) -> DataFrame:
        """(repository, total, active, deleted, files) and the model's dimension."""
        active = F.coalesce("active", F.lit(False))
        each = self.table("chunks").groupBy("repository").agg(F.count("*").alias("total"), F.count_if(active).alias("active"), F.count_if(~active).alias("deleted"), F.count_distinct(F.when(active, F.col("file_path"))).alias("files"))
        return each.withColumn("dimension", F.lit(self.model["dimension"]))

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """Lexical hits (query_id, chunk_id, score, rank) among the active chunks, from the stored postings."""
        p = self.table("postings")
        docs = self.table("chunks").where("active").agg(F.count("*").alias("docs"))
        totals = docs.crossJoin(p.agg(F.sum("tf").alias("words"))).select("docs", (F.col("words") / F.col("docs")).alias("mean_dl"))
        df = p.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(totals))  # one row
        terms = df.select("term", "df", (F.ln(F.col("docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("idf"))
        return retrieval.search((p, terms, totals.crossJoin(terms.agg(F.avg("idf").alias("mean_idf")))), queries, "chunk_id", k)

    def _commit(self, chunks: DataFrame, cache: DataFrame | None, what: str) -> Commit:
        after, folder = self.ledger.latest(), self.ledger.folder()
        chunks = self.ledger.put(folder, "chunks", chunks)
        active = chunks.where("active")
        _, vectors = embedding.embedded(active.select("chunk_id", "content", "content_hash"), cache, self.make)
        self.ledger.put(folder, "vectors", embedding.purged(vectors, active, self.make))
        self.ledger.put(folder, "postings", retrieval.postings(active, "chunk_id", "content"))
        return self.ledger.commit(after, {"version": (after.version if after else 0) + 1}, folder, model=self.model, change=what)

"""Files, JSON, CSV and logs in and out. Everything is read lazily and in parallel; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.files import is_supported
from lodestone.operators.chunks import blank

LOG = "timestamp string, doc_id string, cycle int, score double, routed_to string, per_document_scores string"


def relative_to(root: str, path: Column) -> Column:
    """The part of a file's URI after root; ignored folders are looked for there only, so a checkout below build/ is read."""
    bare = root.split(":", 1)[-1].rstrip("/").lstrip("/") if ":" in root else root.strip("/")
    return F.regexp_replace(F.regexp_replace(path, "^[a-z0-9]+:/*", ""), "^" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in bare) + "/", "")


def scan(spark: SparkSession, root: str, repository: str, newest_bytes: int | None = None) -> DataFrame:
    """(repository, file_path, content, size) of the supported text files under root, blank ones left out.

    A NUL in the first 1024 bytes means binary; what isn't UTF-8 becomes U+FFFD. Contents are read only of files whose path is wanted.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = relative_to(root, F.col("path"))
    kept = raw.withColumn("file_path", path).where(is_supported(F.col("file_path")))
    if newest_bytes is not None:
        kept = kept.where(F.col("length") <= newest_bytes)
    text = kept.where(~_binary(F.col("content")))
    rows = text.select(F.lit(repository).alias("repository"), "file_path", F.expr("string(content)").alias("content"), F.col("length").alias("size"))
    return rows.where(~blank(F.col("content")))


def _binary(content: Column) -> Column:
    """Whether some byte of the first 1024 is 0: an even-placed pair 00 in their hexadecimal form."""
    return F.regexp_replace(F.hex(F.substring(content, 1, 1024)), "([0-9A-F]{2})", "$1 ").contains("00 ")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents of one JSON object each, also over several lines; what doesn't parse gives nulls."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A run log in CSV with a header, its JSON column as a map."""
    rows = spark.read.option("header", "true").option("escape", '"').schema(LOG).csv(path)
    return rows.withColumn("scores", F.from_json("per_document_scores", "map<string,double>")).drop("per_document_scores")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", "true").option("escape", '"').csv(path)


def upsert_latest(old: DataFrame | None, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of both, one for each key: the one of the greatest `order`."""
    both = new if old is None else old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x")).select(*key, "x.*")


def document_path(title: Column) -> Column:
    """Forward slashes, nothing before the first name, and .md at the end."""
    p = F.regexp_replace(F.translate(title, "\\", "/"), "^(?:\\.{0,2}/)+", "")
    return F.when(F.lower(p).endswith(".md"), p).otherwise(F.concat(p, F.lit(".md")))


def is_safe_path(path: Column) -> Column:
    """A relative Markdown path that doesn't leave its folder."""
    return F.coalesce(~path.startswith("/") & ~path.rlike("(^|/)\\.\\.(/|$)") & F.lower(path).endswith(".md"), F.lit(False))


def document_versions(stored: DataFrame, generated: DataFrame, overwrite: bool = True) -> DataFrame:
    """(repository, path, version, content) after writing generated (repository, title, content) over stored ones.

    Blank contents are skipped, equal ones too; without overwrite a stored document stays as it is; two of one path: the longer counts.
    """
    new = generated.where(~blank(F.col("content"))).select("repository", document_path(F.col("title")).alias("path"), "content")
    new = new.groupBy("repository", "path").agg(F.max_by("content", F.struct(F.char_length("content"), "content")).alias("content"))
    last = stored.groupBy("repository", "path").agg(F.max("version").alias("last"), F.max_by("content", "version").alias("old"))
    joined = new.join(last, ["repository", "path"], "left")
    write = F.col("last").isNull() | (F.lit(overwrite) & (F.col("old") != F.col("content")))
    added = joined.where(write).select("repository", "path", (F.coalesce("last", F.lit(0)) + 1).cast("int").alias("version"), "content")
    return stored.select("repository", "path", "version", "content").unionByName(added)


def with_previous(versions: DataFrame) -> DataFrame:
    """Each version with the content before it."""
    return versions.withColumn("previous", F.lag("content").over(W.partitionBy("repository", "path").orderBy("version")))

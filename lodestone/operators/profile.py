"""Profiles of repositories by their file paths: languages, categories, folders, known files, frameworks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import files as fn


def file_table(chunks: DataFrame) -> DataFrame:
    """(repository, file_path, size): each file once, with the code points of its current chunks."""
    from lodestone.operators.chunks import newest

    size = newest(chunks.withColumn("n", F.char_length("content")), "repository", "file_path", "n")
    return size.groupBy("repository", "file_path").agg(F.sum("n").alias("size"))


def language_histogram(files: DataFrame) -> DataFrame:
    """(repository, language, files, percentage): of all files, also those whose language is not known."""
    total = files.groupBy("repository").agg(F.count("*").alias("total"))
    known = files.withColumn("language", fn.profile_language(F.col("file_path"))).where("language is not null").groupBy("repository", "language").agg(F.count("*").alias("files"))
    return known.join(total, "repository").select("repository", "language", "files", F.round(F.col("files") / F.col("total") * 100, 1).alias("percentage"))


def repository_statistics(files: DataFrame) -> DataFrame:
    """Counts by category, number of folders, largest file (the first path of equal ones) and mean size."""
    c = fn.category(F.col("file_path"))
    named = files.withColumns({"category": c, "folder": fn.folder(F.col("file_path"))})
    count = lambda name: F.count_if(F.col("category") == name)
    return named.groupBy("repository").agg(
        F.count("*").alias("files"),
        F.count_distinct("folder").alias("folders"),
        count("Source Code").alias("source_files"),
        count("Test").alias("test_files"),
        count("Configuration").alias("configuration_files"),
        count("Documentation").alias("documentation_files"),
        F.min_by("file_path", F.struct(-F.col("size"), F.col("file_path"))).alias("largest_file"),
        F.round(F.avg("size"), 1).alias("mean_size"),
    )


def folders(files: DataFrame) -> DataFrame:
    """(repository, folder, kind, source_files, has_module_doc): three source files, or a telling name, make a folder worth a document."""
    ext = fn.extension(F.col("file_path"))
    grouped = files.withColumn("folder", fn.folder(F.col("file_path"))).groupBy("repository", "folder").agg(F.count_if(ext.isin([*fn.SOURCE_EXTENSIONS, "h", "sh"])).alias("source_files"))
    kind = fn.folder_kind(F.col("folder"))
    telling = kind.isin("API", "Authentication", "Services", "Database", "RAG / AI", "Feature Module", "Application Layer", "Infrastructure")
    return grouped.select("repository", "folder", kind.alias("kind"), "source_files", ((F.col("source_files") >= 3) | telling).alias("has_module_doc"))


def known_files(files: DataFrame, names: list[str] = fn.IMPORTANT_NAMES) -> DataFrame:
    """(repository, name, present) for every repository and every name."""
    spark = files.sparkSession
    wanted = spark.createDataFrame([(n,) for n in names], "name string")
    present = files.select("repository", fn.base_name(F.col("file_path")).alias("name")).where(F.col("name").isin(names)).distinct().withColumn("there", F.lit(True))
    every = files.select("repository").distinct().crossJoin(F.broadcast(wanted))
    return every.join(present, ["repository", "name"], "left").select("repository", "name", F.coalesce("there", F.lit(False)).alias("present"))


_HEAD = 4096


def frameworks(contents: DataFrame) -> DataFrame:
    """(repository, framework) by rules over (repository, file_path, start_line, content): a word in the first 4096 characters of a named file.

    A file's chunks are put together in the order of their lines (then of their text), a line break after each, as far as they reach
    into its first characters; only files that some rule names are.
    """
    rules = contents.sparkSession.createDataFrame(fn.FRAMEWORK_RULES, "name string, word string, framework string")
    named = contents.withColumn("name", fn.base_name(F.col("file_path"))).where(F.col("name").isin(sorted({r[0] for r in fn.FRAMEWORK_RULES})) & F.col("content").isNotNull())
    order = W.partitionBy("repository", "file_path").orderBy("start_line", "content")
    before = F.coalesce(F.sum(F.char_length("content") + 1).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = named.withColumn("before", before).where(F.col("before") < _HEAD)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("before", F.substring("content", 1, _HEAD).alias("t")))), lambda x: x["t"]), "\n")
    heads = parts.groupBy("repository", "file_path", "name").agg(F.lower(F.substring(joined, 1, _HEAD)).alias("head"))
    return heads.join(F.broadcast(rules), "name").where(F.col("head").contains(F.col("word"))).select("repository", "framework").distinct()


def sorted_directory(files: DataFrame) -> DataFrame:
    """(repository, folder, entry, is_file, position): folders first, then names without case."""
    f = files.select("repository", fn.folder(F.col("file_path")).alias("folder"), fn.base_name(F.col("file_path")).alias("entry"), F.lit(True).alias("is_file"))
    d = f.select("repository", "folder").where("folder <> ''").distinct()
    d = d.select("repository", fn.folder(F.col("folder")).alias("folder"), fn.base_name(F.col("folder")).alias("entry"), F.lit(False).alias("is_file")).distinct()
    order = W.partitionBy("repository", "folder").orderBy("is_file", F.lower("entry"), "entry")
    return d.unionByName(f).withColumn("position", F.row_number().over(order))

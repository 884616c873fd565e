"""What a question about a repository asks for, by its wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.files import base_name

#: Wording of questions about a file's history and about its content.
HISTORY = "(?i)\\bwho\\b.*\\b(?:edit|edited|change|changed|modif|wrote|write|author|touch|touched|commit|committed)\\b|\\bhistory of\\b|\\bcommit history\\b|\\blast (?:edited|changed|modified)\\b|\\bwhen was\\b.*\\b(?:changed|edited|modified|created|added)\\b"
CONTENT = "(?i)\\bwhat(?:'s| is| does)?\\b.*\\b(?:in|inside|contain)\\b|\\bshow me\\b|\\bcontents? of\\b|\\bwhat's inside\\b"


def intent(question: Column) -> Column:
    return F.when(question.rlike(HISTORY), "file_history").when(question.rlike(CONTENT), "file_content").otherwise("general")


def file_hint(question: Column) -> Column:
    """What stands in backticks and has an extension, else the first word with one; null for none."""
    quoted = F.regexp_extract(question, "`([^`]+\\.[A-Za-z0-9]{1,6})`", 1)
    word = F.regexp_extract(question, "\\b(\\w[\\w\\-./\\\\]*\\.[A-Za-z0-9]{1,6})\\b", 1)
    return F.when(quoted != "", quoted).when(word != "", word)


def resolved_files(questions: DataFrame, files: DataFrame) -> DataFrame:
    """(query_id, file_path): the file of exactly the hinted path, or all files of that name."""
    asked = questions.select("query_id", file_hint(F.col("text")).alias("hint")).where("hint is not null")
    exact = asked.join(files.select(F.col("file_path").alias("hint"), "file_path"), "hint").select("query_id", "file_path")
    rest = asked.join(exact, "query_id", "left_anti").withColumn("name", base_name(F.col("hint")))
    named = rest.join(files.select("file_path", base_name(F.col("file_path")).alias("name")), "name").select("query_id", "file_path")
    return exact.unionByName(named)

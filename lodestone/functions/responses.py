"""Semi-structured answers of language models, and Markdown made from columns. All in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def sections(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, body): a line "NAME:" in capitals begins a section, and what stands after the colon belongs to it; text before the first is dropped."""
    lines = answers.select(F.col(key), F.posexplode(F.split(F.col(text), "\\r?\\n")).alias("at", "line"))
    head = F.regexp_extract("line", "^\\s*(?:[#*]+\\s*)?([A-Z][A-Z0-9_ ]{1,60}?)(?:\\*+)?:", 1)
    order = W.partitionBy(key).orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    lines = lines.withColumn("name", F.when(head != "", head)).withColumn("section", F.count("name").over(order)).where("section > 0")
    rest = F.when(F.col("name").isNotNull(), F.regexp_replace("line", "^[^:]*:(?:\\*+)?", "")).otherwise(F.col("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", rest.alias("rest")))), lambda x: x["rest"]), "\n")
    grouped = lines.groupBy(key, "section").agg(F.max("name").alias("name"), body.alias("body"))
    return grouped.select(key, "name", _strip(F.col("body")).alias("body"))


def table_rows(text: Column, width: int) -> Column:
    """The rows "a | b | c" of a text with at least `width` cells, without rules between rows; outer bars don't count."""
    lines = F.transform(F.split(text, "\\r?\\n"), lambda x: F.regexp_replace(x, "^\\s*[-*]?\\s*\\|?|\\|\\s*$", ""))
    cells = F.transform(F.filter(lines, lambda x: x.contains("|") & ~x.rlike("^[\\s|:-]+$")), lambda x: F.transform(F.split(x, "\\|"), _strip))
    return F.filter(cells, lambda c: F.size(c) >= width)


def arrows(text: Column) -> Column:
    """The edges "x -> y" of a text as structs (src, dst)."""
    parts = F.transform(F.filter(F.split(text, "\\r?\\n"), lambda x: x.contains("->")), lambda x: F.split(F.regexp_replace(x, "^\\s*[-*]\\s+", ""), "->"))
    edges = F.transform(parts, lambda p: F.struct(_strip(p[0]).alias("src"), _strip(p[1]).alias("dst")))
    return F.filter(edges, lambda e: (e["src"] != "") & (e["dst"] != ""))


def score(text: Column, label: str) -> Column:
    """The number after "LABEL:", within 0 and 100; null for none."""
    number = F.regexp_extract(text, f"(?i){label}\\s*:\\s*\\**\\s*(-?\\d+(?:\\.\\d+)?)", 1)
    return F.when(number != "", F.greatest(F.lit(0.0), F.least(F.lit(100.0), number.try_cast("double"))))


def changelog_commits(text: Column) -> Column:
    """How many commits a changelog lists: "## [sha]" headings."""
    return F.regexp_count(text, F.lit("(?m)^## \\[[^\\]\\n]+\\]"))


def changelog_authors(text: Column) -> Column:
    """The authors of a changelog, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("(?m)^\\*\\*Author:\\*\\*[ \\t]*([^\\r\\n]*)"), F.lit(1)), _strip))


def heading(text: Column, level: int = 1) -> Column:
    return F.concat(F.lit("#" * level + " "), text)


def bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def numbered(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def code_block(text: Column, language: str = "") -> Column:
    return F.concat(F.lit(f"```{language}\n"), text, F.lit("\n```"))


def table(header: list[str], rows: Column) -> Column:
    """A Markdown table of an array of arrays of strings; bars in cells are escaped."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | ", "-"), F.lit(" |"))
    body = F.transform(rows, lambda r: line(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|")))))
    top = F.array(F.lit("| " + " | ".join(header) + " |"), F.lit("| " + " | ".join("---" for _ in header) + " |"))
    return F.array_join(F.concat(top, body), "\n")


def flowchart(edges: Column) -> Column:
    """A Mermaid flowchart of structs (src, dst)."""
    return F.concat(F.lit("```mermaid\nflowchart TD\n"), F.array_join(F.transform(edges, lambda e: F.concat(F.lit("    "), e["src"], F.lit(" --> "), e["dst"])), "\n"), F.lit("\n```"))


def retrieval_parameters(symbols: Column, base_k: int = 10, most_k: int = 100, base_threshold: float = 0.05, step: float = 0.01, baseline: int = 1) -> Column:
    """struct (top_k, threshold): wider changes ask for more and less similar results."""
    extra = F.greatest(F.lit(0), symbols - baseline)
    return F.struct(F.least(F.lit(most_k), base_k + extra).alias("top_k"), F.round(F.greatest(F.lit(0.0), base_threshold - extra * step), 4).alias("threshold"))


def query_text(parts: list[tuple[str, Column]]) -> Column:
    """"Label: a, b. ..." of labelled arrays; empty ones are left out."""
    return F.concat_ws(" ", *(F.when(F.size(items) > 0, F.concat(F.lit(f"{label}: "), F.array_join(items, ", "), F.lit("."))) for label, items in parts))

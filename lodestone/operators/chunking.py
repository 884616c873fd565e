"""Files cut into chunks: Python by its definitions, other code by the lines that begin one, prose by headings or paragraphs.

A file is cut in one Arrow batch row. A piece over the token limit is cut again between lines, with whole lines of overlap. Lines that
no definition covers become module chunks. Blank files and blank pieces give no chunk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import files as fn
from lodestone.functions import ids, text
from lodestone.operators.symbols import DEFINITION_PATTERNS, tree_symbols

LIMIT, OVERLAP = 1024, 100
DRAFTS = "key long, chunk_type string, symbol_name string, symbol_type string, parent_symbol string, start_line int, end_line int, content string"
_STARTS = [(kind, re.compile(p)) for kind, p in DEFINITION_PATTERNS]
_HEADING = re.compile(r"^#{1,6}[ \t]+(\S.*)$")


def tokens(n: int) -> int:
    return max(1, n // 4) if n else 0


def cut_lines(lines: list[str], first: int, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of pieces under `limit` tokens; a line over it is a piece of its own. Each piece begins with
    as many whole last lines of the one before as stay within `overlap` tokens. Takes time in proportion to the lines."""
    sizes = [len(x) + 1 for x in lines]
    if tokens(sum(sizes) - 1) <= limit:
        return [(first, first + len(lines) - 1, "\n".join(lines))] if lines else []
    out, start, at = [], 0, 0
    while at < len(lines):
        end, size = at, sum(sizes[start:at])
        while end < len(lines) and (end == at and size == 0 or tokens(size + sizes[end] - 1) < limit):
            size += sizes[end]
            end += 1
        if end == at:  # the overlap leaves no room for the next line
            start = at
            continue
        out.append((first + start, first + end - 1, "\n".join(lines[start:end])))
        at = start = end
        back = 0
        while start > 0 and tokens(back + sizes[start - 1] - 1) <= overlap and end < len(lines):
            start -= 1
            back += sizes[start]
    return out


def _code(source: str, language: str) -> list[tuple[str | None, str, str | None, int, int]]:
    """(symbol, type, parent, first, last) of the definitions of a file."""
    if language == "python":
        return [(name, kind, parent, a, b) for name, kind, parent, a, b, _, _ in tree_symbols(source)]
    lines, found = source.split("\n"), []
    for i, line in enumerate(lines, 1):
        for kind, p in _STARTS:
            if (len(line) < 2000) and (m := p.search(line)):
                found.append((m.group(1), kind, None, i))
                break
    ends = [f[3] - 1 for f in found[1:]] + [len(lines)]
    return [(name, kind, parent, a, max(a, b)) for (name, kind, parent, a), b in zip(found, ends)]


def drafts(source: str | None, language: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[str, str | None, str, str | None, int, int, str]]:
    """(chunk type, symbol, symbol type, parent, first line, last line, text)."""
    source = re.sub(r"\r\n?", "\n", source or "")
    if not source.strip():
        return []
    lines = source.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    out = []

    def add(chunk_type: str, name: str | None, kind: str, parent: str | None, a: int, b: int) -> None:
        while a <= b and not lines[a - 1].strip():
            a += 1
        while b >= a and not lines[b - 1].strip():
            b -= 1
        for x, y, piece in cut_lines(lines[a - 1 : b], a, limit, overlap):
            if piece.strip():
                out.append((chunk_type, name, kind, parent, x, y, piece))

    if language == "documentation":
        fence, heading, start = False, None, 1
        for i, line in enumerate(lines, 1):
            fence ^= line.lstrip().startswith("```")
            m = None if fence else _HEADING.match(line)
            if m:
                add("documentation", heading, "section", None, start, i - 1)
                heading, start = m.group(1).strip(), i
        add("documentation", heading, "section", None, start, len(lines))
        return out
    found, last = _code(source, language), 0
    for name, kind, parent, a, b in sorted(found, key=lambda f: (f[3], f[4])):
        if a > last + 1:
            add("code", None, "module", None, last + 1, a - 1)
        add("code", name, kind, parent, a, min(b, len(lines)))
        last = max(last, b)
    if last < len(lines):
        add("code", None, "module", None, last + 1, len(lines))
    return out


def _run(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, language, source in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [(key, *d) for d in drafts(source, language, limit, overlap)]
                if rows:
                    types = [pa.int64(), *[pa.string()] * 4, pa.int32(), pa.int32(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["key", "chunk_type", "symbol_name", "symbol_type", "parent_symbol", "start_line", "end_line", "content"])

    return run


def chunked(files: DataFrame, commit: str | None = None, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Chunk rows of (repository, file_path, content); files whose extension is neither code nor prose are left out."""
    language = fn.language(F.col("file_path"))
    rows = files.where(language != "unknown").withColumns({"language": language, "key": F.xxhash64("repository", "file_path")})
    d = rows.select("key", "language", "content").mapInArrow(_run(limit, overlap), DRAFTS)
    out = d.join(rows.select("key", "repository", "file_path", F.col("language").alias("prog_lang")), "key")
    digest = ids.content_hash(F.col("content"))
    identity = ids.chunk_id(F.col("repository"), F.col("file_path"), F.col("symbol_name"), F.col("start_line"), F.col("end_line"), digest)
    return out.select(identity.alias("chunk_id"), "repository", "file_path", "prog_lang", "chunk_type", "symbol_name", "symbol_type", "parent_symbol", "start_line", "end_line", "content", digest.alias("content_hash"), text.estimate_tokens(F.col("content")).alias("token_count"), F.lit(True).alias("active"), F.lit(commit).cast("string").alias("commit_sha"))

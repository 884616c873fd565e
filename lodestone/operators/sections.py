"""Prose cut into sections: by paragraphs, by Markdown, reStructuredText and HTML headings; sections over a limit cut into pieces.

A text is cut in its own row, in one Arrow pass: nothing is shuffled or sorted.

Lines end with \\n, \\r or \\r\\n; a section's content is its lines without white space around them; sections without any text
are dropped; null and blank documents have none. start_line and end_line are a section's first and last line that isn't blank.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = "\t\n\x0b\x0c\r "
_BLANK = re.compile(r"[\t-\r ]*$")
_FENCE, _ATX = re.compile(r"[\t-\r ]*```"), re.compile(r"#{1,6}[\t ]+([^\t ].*)")
#: What underlines a title, and a heading that has a line of its own.
_UNDERLINE = re.compile(r"(=|-|`|:|~|'|\"|\^|\+|\*){3,}$")
_TAGGED = re.compile(r"<h([1-6])[^>]*>(.*?)</h\1>$", re.IGNORECASE)
_TAG = re.compile(r"<[^>]+>")

#: (heading, number of the first line, lines)
Section = tuple[str | None, int, list[str]]


def lines_of(text: str) -> list[str]:
    """The lines of a text, without the empty one after a final line end."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return lines[:-1] if len(lines) > 1 and not lines[-1] else lines


def by_paragraph(lines: list[str]) -> Iterator[Section]:
    start, part = 1, []
    for i, line in enumerate(lines, 1):
        if _BLANK.match(line):
            if part:
                yield None, start, part
            part = []
        else:
            if not part:
                start = i
            part.append(line)
    if part:
        yield None, start, part


def by_markdown(lines: list[str]) -> Iterator[Section]:
    """A heading outside of fenced code begins a section, with its own line in it."""
    heading, start, fenced = None, 1, False
    for i, line in enumerate(lines, 1):
        if _FENCE.match(line):
            fenced = not fenced
        elif not fenced and (m := _ATX.match(line)):
            yield heading, start, lines[start - 1 : i - 1]
            heading, start = m.group(1).strip(_SPACE), i
    yield heading, start, lines[start - 1 :]


def by_underline(lines: list[str]) -> Iterator[Section]:
    """A line that isn't blank, with a line of three or more title marks below it, begins a section; a text's first title only names the text before the next."""
    heading, start = None, 1
    for i in range(1, len(lines)):
        title = lines[i - 1].strip(_SPACE)
        if title and _UNDERLINE.match(lines[i].strip(_SPACE)):
            yield heading, start, lines[start - 1 : i - 1]
            heading, start = title, i
    yield heading, start, lines[start - 1 :]


def by_tag(lines: list[str]) -> Iterator[Section]:
    """A heading element that has a line of its own begins a section; its tags don't belong to the heading."""
    heading, start = None, 1
    for i, line in enumerate(lines, 1):
        if m := _TAGGED.match(line.strip(_SPACE)):
            yield heading, start, lines[start - 1 : i - 1]
            heading, start = _TAG.sub("", m.group(2)).strip(_SPACE), i
    yield heading, start, lines[start - 1 :]


def trimmed(sections: Iterator[Section]) -> Iterator[tuple[str | None, int, int, str]]:
    """(heading, start_line, end_line, content) of the sections with any text."""
    for heading, start, lines in sections:
        filled = [i for i, x in enumerate(lines) if not _BLANK.match(x)]
        if filled:
            yield heading, start + filled[0], start + filled[-1], "\n".join(lines).strip(_SPACE)


def _tokens(n: int) -> int:
    return max(1, n // 4) if n else 0


def section_pieces(content: str, limit: int, overlap: int) -> list[str]:
    """A section over `limit` tokens in pieces between its paragraphs; a paragraph over it is a piece of its own.

    A piece begins with as many whole last paragraphs of the one before as stay within `overlap` tokens.
    """
    if _tokens(len(content)) <= limit:
        return [content]
    parts = [p.strip(_SPACE) for p in re.split(r"\n[\t-\r ]*\n", content)]
    parts = [p for p in parts if p]
    out, current, size = [], [], 0
    for p in parts:
        if current and _tokens(size + 2 + len(p)) > limit:
            out.append("\n\n".join(current))
            back, length = [], 0
            for q in reversed(current):
                if _tokens(length + len(q) + (2 if back else 0)) > overlap:
                    break
                length += len(q) + (2 if back else 0)
                back.insert(0, q)
            current, size = [*back, p], length + (2 if back else 0) + len(p)
        else:
            size += len(p) + (2 if current else 0)
            current.append(p)
    return [*out, "\n\n".join(current)] if current else out


def _cut(kind: Callable[[list[str]], Iterator[Section]], names: list[str], limit: int | None, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                for heading, a, b, content in trimmed(kind(lines_of(text))):
                    pieces = [content] if limit is None else section_pieces(content, limit, overlap)
                    for no, piece in enumerate(pieces):
                        at.append(i)
                        rows.append((heading, a, b, no, piece))
            cols = list(zip(*rows)) if rows else [[]] * 5
            types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types))], names=names)

    return run


def cut(documents: DataFrame, kind: Callable[[list[str]], Iterator[Section]], key: str = "doc_id", text: str = "text", limit: int | None = None, overlap: int = 100) -> DataFrame:
    """(key, heading, start_line, end_line, piece, content); piece counts from 0 within a section, the lines are the section's."""
    names = [key, "heading", "start_line", "end_line", "piece", "content"]
    schema = f"`{key}` {dict(documents.dtypes)[key]}, heading string, start_line int, end_line int, piece int, content string"
    return documents.select(F.col(key), F.col(text)).mapInArrow(_cut(kind, names, limit, overlap), schema)


def paragraphs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_line, end_line, content): blank lines part paragraphs."""
    return cut(documents, by_paragraph, key, text).select(key, "start_line", "end_line", "content")


def markdown_sections(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return cut(documents, by_markdown, key, text).drop("piece")


def rst_sections(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return cut(documents, by_underline, key, text).drop("piece")


def html_sections(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return cut(documents, by_tag, key, text).drop("piece")

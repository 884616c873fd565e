"""Oversized contents as pieces under a token limit, cut at natural boundaries, with a set overlap.

Tokens are code points divided by 4, rounded down, and 1 at least where there is any text; so the offset of token t is
4 t and the longest piece of `limit` tokens has 4 limit + 3 code points. Each content is turned once into sorted arrays of
boundary positions: after a blank line, after a line, after a sentence, after white space. The cut is the last
boundary under the limit, by binary search in the first of these arrays that has one late enough to leave more than the
overlap and at least half of the limit; without any, the last boundary of whatever kind that moves on, and without that a
hard cut. The next piece starts `overlap` tokens before the cut.

Defined results
- contents of `limit` tokens or less are one piece, the content itself; null and empty contents give no piece
- line numbers count from the chunk's start_line (1 if null), lines end with \\n; a piece that begins with the last
  character of a line begins on that line, and end_line is the line of the piece's last character
- `piece_no` counts from 0; joining the pieces without their first 4 * overlap code points (but for piece 0) gives the content
- a chunk_id's rows differ in state only: its newest row is cut; rows without chunk_id are dropped
- contents of any length are cut whole, in time that grows with the length; further columns are dropped
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, PER_TOKEN = 1024, 100, 4

_BOUNDARIES = [re.compile(r"\n[^\S\n]*\n"), re.compile(r"\n"), re.compile(r"[.!?。！？](?=\s)|[。！？]"), re.compile(r"\s")]
PIECES = "chunk_id string, piece_no int, content string, start_line int, end_line int, token_count int"


def token_count(text: Column) -> Column:
    n = F.char_length(text)
    return F.when(n > 0, F.greatest(F.lit(1), F.floor(n / PER_TOKEN).cast("int"))).otherwise(F.lit(0))


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each piece in code points."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and under the limit")
    most, back, n = limit * PER_TOKEN + PER_TOKEN - 1, overlap * PER_TOKEN, len(text)
    if n <= most:
        return [(0, n)] if n else []
    levels = [np.fromiter((m.end() for m in p.finditer(text)), np.int64) for p in _BOUNDARIES]
    pieces, start = [], 0
    while n - start > most:
        end = 0
        for least in (start + max(back, most // 2), start + back):
            for level in levels:
                k = bisect_right(level, start + most)
                if k and level[k - 1] > least:
                    end = int(level[k - 1])
                    break
            if end:
                break
        end = end or start + most
        pieces.append((start, end))
        start = end - back
    pieces.append((start, n))
    return pieces


def _run(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, first in zip(*(c.to_pylist() for c in batch.columns)):
                ends = np.fromiter((m.end() for m in re.finditer("\n", text)), np.int64)
                pieces = cut(text, limit, overlap)
                at = np.array(pieces, np.int64).reshape(-1, 2)
                lines = np.searchsorted(ends, np.stack([at[:, 0], np.maximum(at[:, 1] - 1, 0)]), "right") + (1 if first is None else first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(pieces), pa.string()), pa.array(range(len(pieces)), pa.int32()), pa.array([text[a:b] for a, b in pieces], pa.string()), *(pa.array(x.astype(np.int32)) for x in lines), pa.array([max(1, (b - a) // PER_TOKEN) for a, b in pieces], pa.int32())],
                    names=["chunk_id", "piece_no", "content", "start_line", "end_line", "token_count"],
                )

    return run


def oversized_pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every chunk over the limit. Only contents over the limit are shuffled or seen by Python."""
    over = chunks.where(F.col("chunk_id").isNotNull() & (token_count(F.col("content")) > limit))
    newest = over.groupBy("chunk_id").agg(F.max_by(F.struct("content", "start_line"), F.struct("created_at", "content")).alias("x"))
    return newest.select("chunk_id", "x.content", "x.start_line").mapInArrow(_run(limit, overlap), PIECES)


def split_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """All chunks in pieces; those within the limit stay as they are, with their token_count put right."""
    fits = chunks.where(F.col("chunk_id").isNotNull() & (token_count(F.col("content")) <= limit) & (F.char_length("content") > 0))
    newest = fits.groupBy("chunk_id").agg(F.max_by(F.struct("content", "start_line"), F.struct("created_at", "content")).alias("x"))
    first = F.coalesce("x.start_line", F.lit(1))
    breaks = F.char_length("x.content") - F.char_length(F.regexp_replace("x.content", "\n(?!$)|\n(?=\n$)", ""))
    whole = newest.select("chunk_id", F.lit(0).alias("piece_no"), "x.content", first.alias("start_line"), (first + breaks).cast("int").alias("end_line"), token_count(F.col("x.content")).alias("token_count"))
    return whole.unionByName(oversized_pieces(chunks, limit, overlap))

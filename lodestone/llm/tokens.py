"""Texts as token ids of a public byte-level BPE vocabulary, by forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can't be merged over, so a cut between them
never changes the encoding. The cut must not change the split into words that precedes merging either, so it is only
made where the character before is no white space (the split looks ahead only past white space) and the one after is no
apostrophe (contractions are the only alternative of the split that depends on where it starts). Both are checked
on the bytes of a whole Arrow batch at once. What lies between two cuts is encoded by itself, each distinct fragment of a
batch once, and the ids are put together by the offsets of the cuts.

Defined results
- null and empty texts: an empty list; blank ones are encoded as they stand
- what looks like a special token is plain text; no special tokens are added
- texts of any length are encoded whole; equal texts get equal ids; a repeated key gives a row for each of its rows
- key and text are taken by name, further columns are dropped, so their names can't clash
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published word split of this vocabulary.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Last bytes of white space beyond ASCII, and of characters that some libraries count as such.
_WIDE_SPACE = [0xE19A80, 0xE1A08E, *range(0xE28080, 0xE28090), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE28180, 0xE38080, 0xEFBBBF]
_NARROW_SPACE = [0xC285, 0xC2A0]
_LONG = 10_000
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{5000,}")

_LOADED: dict[str, "Encoder"] = {}


class Encoder:
    """A vocabulary file, the byte pairs inside its tokens, and the encoding of Arrow arrays."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        inside = np.zeros((256, 256), np.bool_)
        for token in ranks:
            b = np.frombuffer(token, np.uint8)
            inside[b[:-1], b[1:]] = True
        may_cut = ~inside
        may_cut[[*range(33), 127], :] = False  # white space and control characters before
        may_cut[:, 0x27] = False  # an apostrophe after
        may_cut[:, 0x80:0xC0] = False  # inside a character
        self.may_cut = may_cut.ravel()

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Positions in UTF-8 bytes before which a cut changes nothing."""
        if len(data) < 2:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.may_cut[(data[:-1].astype(np.int32) << 8) | data[1:]]) + 1
        wide = data[at - 1] >= 0x80
        if wide.any():
            w = at[wide]
            low = data[w - 2].astype(np.int32) << 8 | data[w - 1]
            full = data[np.maximum(w - 3, 0)].astype(np.int32) << 16 | low
            bad = np.zeros(len(at), np.bool_)
            bad[wide] = np.isin(low, _NARROW_SPACE) | np.isin(full, _WIDE_SPACE)
            at = at[~bad]
        return at

    def encode_fragment(self, text: str) -> list[int]:
        """Runs of white space too long for the library's split go past it: all but the last of such a run is one word."""
        if len(text) < _LONG:
            return self.bpe.encode_ordinary(text)
        ids, at = [], 0
        for run in _LONG_SPACE.finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += self.bpe.encode_ordinary(text[at : run.start()])
            ids += self.bpe._encode_single_piece(text[run.start() : end])
            at = end
        return ids + self.bpe.encode_ordinary(text[at:])

    def encode(self, texts: pa.Array) -> pa.Array:
        """A list of ids for each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        low, high = (int(ends[0]), int(ends[-1])) if len(texts) else (0, 0)
        if high == low:
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.int32()))
        data = np.frombuffer(texts.buffers()[2], np.uint8)[low:high]
        ends = ends - low
        marks = np.zeros(len(data) + 1, np.bool_)
        marks[self.cuts(data)] = True
        marks[ends] = True
        bounds = np.flatnonzero(marks)
        fragments = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        known = [self.encode_fragment(t) for t in fragments.dictionary.to_pylist()]
        lengths = np.fromiter(map(len, known), np.int64, len(known))
        flat = np.fromiter(chain.from_iterable(known), np.int32, int(lengths.sum()))
        starts = np.concatenate([[0], np.cumsum(lengths)])
        which = fragments.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        each = lengths[which]
        offsets = np.concatenate([[0], np.cumsum(each)])
        take = np.arange(offsets[-1]) + np.repeat(starts[which] - offsets[:-1], each)
        by_text = offsets[np.searchsorted(bounds, ends)]
        return pa.ListArray.from_arrays(pa.array(by_text.astype(np.int32)), pa.array(flat[take]))


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """The encoder of this process; the file is read once."""
    if vocabulary not in _LOADED:
        _LOADED[vocabulary] = Encoder(vocabulary)
    return _LOADED[vocabulary]


def _map(vocabulary: str, key: str, only_count: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                ids = e.encode(part.column(1))
                out = pc.list_value_length(ids) if only_count else ids
                yield pa.RecordBatch.from_arrays([part.column(0), out], names=[key, "n_tokens" if only_count else "ids"])

    return run


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>), one row for each row of documents."""
    kind = dict(documents.dtypes)[key]
    return documents.select(F.col(key), F.col(text)).mapInArrow(_map(vocabulary, key, False), f"`{key}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens int), one row for each row of documents; ids don't leave the worker."""
    kind = dict(documents.dtypes)[key]
    return documents.select(F.col(key), F.col(text)).mapInArrow(_map(vocabulary, key, True), f"`{key}` {kind}, n_tokens int")

import random

import pyarrow as pa
import pytest

from lodestone.llm import tokens


def _plain(text):
    return tokens.encoder().bpe.encode_ordinary(text or "")


CASES = [None, "", " ", "\n\n", "a\n\n  b", "don't 'tis they've", "!'s 're", "x" * 5000, " " * 3000, "=" * 700 + "a", "<|endoftext|>", "日本語の文章。 前 後", "a　b c  d", "﻿a​b", "naïve café ’s “x”", "🙂👩‍💻 é", "tab\there\r\nline\x0b\x85z", "\x00\x01 a", "٣٤ ab12cd"]


def test_same_as_the_whole_text_at_once():
    got = tokens.encoder().encode(pa.array(CASES)).to_pylist()
    assert got == [_plain(t) for t in CASES]


def test_random_texts():
    rng = random.Random(5)
    alphabet = list("ab  \n\t'sStT!.,0９١") + ["é", "日", "本", "　", " ", "'re", "🙂", "́", " ", "ß", "Ж", "\x1c", "᠎"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(3000)]
    assert tokens.encoder().encode(pa.array(texts)).to_pylist() == [_plain(t) for t in texts]


def test_sliced_and_empty_arrays():
    a = pa.array(CASES).slice(5, 4)
    assert tokens.encoder().encode(a).to_pylist() == [_plain(t) for t in CASES[5:9]]
    assert tokens.encoder().encode(pa.array([], pa.string())).to_pylist() == []


def test_frame_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 3), (2, None, 4), (1, "a b", 5)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in tokens.token_ids(df).collect())
    assert got == [(1, _plain("a b")), (1, _plain("a b")), (2, [])]
    assert sorted(r.n_tokens for r in tokens.token_counts(df).collect()) == [0, 2, 2]
    assert tokens.token_ids(df.limit(0)).collect() == []


def test_other_library_agrees():
    lib = pytest.importorskip("tokenizers")
    t = lib.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = [x for x in CASES if x]
    assert [e.ids for e in t.encode_batch(texts, add_special_tokens=False)] == tokens.encoder().encode(pa.array(texts)).to_pylist()


def test_very_long_runs():
    e = tokens.encoder()
    for text in (" " * 20_000 + "x", "a" + "\n" * 12_000, "b" + " \n" * 9_000 + "c d" + " " * 6_000, "y" * 30_000):
        assert e.encode_fragment(text) == e.bpe.encode_ordinary(text)
    assert len(e.encode(pa.array([" " * 2_000_000 + "x", "z" * 2_000_000]))) == 2

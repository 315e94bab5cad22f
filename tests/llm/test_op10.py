import random
import zlib

import numpy as np
import pytest

from quillgraph.llm import op10_token_output as op
from quillgraph.llm import range_coder


def brute(rows):
    from tokenizers import Tokenizer

    t, at, out = Tokenizer.from_file(op.default_tokenizer()), 0, {}
    for i, x in sorted(rows):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        out[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


def got(df):
    return {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in df.collect()}


def test_round_trip(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    assert got(op.tokens(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("rows", [[], [(1, None)], [(5, ""), (2, "é" * 9000), (3, "a b " * 5000), (4, "<|endoftext|>")], [(None, "a"), (3, "x"), (3, "x")]])
def test_odd_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as part", "2 as ids")
    assert got(op.tokens(df)) == brute({i: (i, t) for i, t in rows if i is not None}.values())


def test_coder():
    rng = np.random.default_rng(1)
    blocks = [rng.zipf(1.3, rng.integers(1, 2049)).clip(0, 50256).astype(np.uint32) for _ in range(40)]
    blocks += [np.array([5], np.uint32), np.full(2048, 7, np.uint32), np.tile(np.arange(9, dtype=np.uint32), 200)]
    raw = range_coder.encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, range_coder.decode(raw), strict=True))
    assert len(raw[-2]) < 120
    with pytest.raises(ValueError):
        range_coder.decode([raw[0][:-9] + b"x" + raw[0][-8:]])


def test_crc_join():
    a, b = b"hello", b" world" * 99
    assert op.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_words_are_those_of_the_library():
    rnd, words = random.Random(1), op.Words(op.default_tokenizer())
    parts = [*"abs tdm lrev\'  \n\t 12!?.é中٣²\u00a0\u3000\u200b😀Ⅷ\u0301_ſ", "'s", "'ll", "'re", " '", "  ", "<|endoftext|>"]
    texts = ["", "'", " ", "  ", "'s", "x's'", "a  ", "  a", *("".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(3000))]
    for some in (texts, texts[::-1]):  # the second time from what is remembered
        want = words.tokenizer.encode_batch(some, add_special_tokens=False)
        assert [x.tolist() for x in words.encode(some)] == [x.ids for x in want]


def test_library_gets_a_word_once(monkeypatch):
    words, asked = op.Words(op.default_tokenizer()), []
    new = words._new
    monkeypatch.setattr(words, "_new", lambda some: asked.extend(some) or new(some))
    for _ in range(2):
        words.encode(["one two one two", "two one"])
    assert sorted(asked) == [" one", " two", "one", "two"]


def test_coder_of_full_blocks():
    """Blocks of distinct ids, and ids of 32 bits."""
    blocks = [np.arange(2048, dtype=np.uint32) * 3, np.array([2**32 - 1, 0, 2**32 - 1], np.uint32)]
    assert all(np.array_equal(a, b) for a, b in zip(blocks, range_coder.decode(range_coder.encode(blocks)), strict=True))


def test_crc_matrices_are_made_once():
    op.crc32_joined(1, 2, 8191)
    made = op._zero_bits.cache_info().misses
    op.crc32_joined(3, 4, 8191)
    assert op._zero_bits.cache_info().misses == made

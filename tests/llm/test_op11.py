import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import op11_bpe_monoid as op

PATH, PATTERN = op.default_vocabulary()
CODEC = op.codec(PATH, PATTERN)
KNOWN = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, special_tokens={})


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def brute(rows):
    out = {}
    for i, t in rows:
        ids = KNOWN.encode_ordinary(t or "")
        raw = np.array(ids, "<u4").tobytes()
        out[i] = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(KNOWN.decode_bytes(ids)).hexdigest())
    return out


def got(df):
    rows = op.decode(op.encode(df)).selectExpr("doc_id", "int(octet_length(ids) / 4) n", "sha2(ids, 256) a", "sha2(decoded, 256) b").collect()
    assert len(rows) == len({r.doc_id for r in rows})
    return {r.doc_id: (r.n, r.a, r.b) for r in rows}


def test_documents(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(docs) == want
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op.query(spark, sf_small).collect()} == want


@pytest.mark.parametrize("rows", [[], [(1, None)], [(5, ""), (2, "é" * 40_000), (3, "a b " * 20_000), (4, "<|endoftext|>"), (6, " " * 70_000 + "x"), (7, "'" * 33_000 + "re" * 20_000)], [(None, "a"), (3, "x"), (3, "x")], [(1, "b"), (1, "a")]])
def test_odd_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as ids", "2 as leaf", "3 as sizes", "4 as decoded")
    assert got(df) == brute({i: (i, t) for i, t in sorted(rows, key=str, reverse=True) if i is not None}.values())


def test_cut_anywhere():
    """Leaves of a few characters give what the whole text gives, wherever they are cut."""
    rnd = random.Random(3)
    alphabet = ["'", "'r", "e", "'ll", " ", "  ", "\n", "\t", "a", "the", "é", "界", "9", "12", "!", "...", "😀", " ", "\x1c", "​"]
    for _ in range(1500):
        text = "".join(rnd.choices(alphabet, k=rnd.randrange(1, 60)))
        cuts = sorted(rnd.sample(range(1, len(text)), min(len(text) - 1, rnd.randrange(0, 12))))
        parts = [CODEC.leaf(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        assert CODEC.reduce(parts).ids.tolist() == KNOWN.encode_ordinary(text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    ids = ids_of(CODEC.encode(text))
    assert ids == KNOWN.encode_ordinary(text)
    assert b"".join(CODEC.decode(np.array(ids, "<u4").tobytes())) == text.encode()


@pytest.mark.parametrize("alphabet", ["a", "ab", "aab ", "abcde", "ст", "界面", "=-", "\n "])
def test_joins_of_bytes(alphabet):
    """Long matches of few letters: halves join to what merging the whole gives."""
    rnd = random.Random(alphabet)
    for n in (1, 17, 40, 100, 257, 700, 3000):
        raw = "".join(rnd.choices(alphabet, k=n)).encode()
        assert CODEC.merges.encode(raw) == CODEC.merges._merge_scan(raw) == CODEC.merges._merge_heap(raw)


def test_every_character():
    """The pattern's classes are those of the library for every code point."""
    for first in range(0, 0x110000, 0x1000):
        text = "".join(f"a{c}b {c}1{c} {c}\n" for c in map(chr, range(first, first + 0x1000)) if not 0xD800 <= ord(c) < 0xE000)
        assert ids_of(CODEC.encode(text)) == KNOWN.encode_ordinary(text), hex(first)

import hashlib
import random
from collections import Counter

import pytest

from quillgraph.llm import op9_suffix_dedup as op

L = op.LENGTH


def brute(rows):
    texts = {i: (t or "").encode() for i, t in rows}
    seen = Counter(b[k : k + L] for b in texts.values() for k in range(len(b) - L + 1))
    out = {}
    for i, b in texts.items():
        gone = bytearray(len(b))
        for k in range(len(b) - L + 1):
            if seen[b[k : k + L]] > 1:
                gone[k : k + L] = b"\1" * L
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_planted(spark):
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abcdé \n") for _ in range(n))
    p, q = text(700), text(400)
    rows = [(1, text(900) + p + text(300)), (2, p[20:650] + text(500)), (3, text(200) + p[100:520]), (4, q), (5, "x" + q + "y"), (6, q[1:] + "z" * 3), (7, None), (8, ""),
            (9, "a" * 1500), (10, "ab" * 300), (11, text(5000)), (12, q[:399]), (13, text(399) + p[:401]), (14, p), (15, p)]
    rows += [(100 + k, text(rnd.randrange(60)) + p[k : k + 395 + k % 12] + text(50)) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(op.remove_repeats(df, batch_bytes=4000)) == brute(rows)


def test_against_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(op.remove_repeats(docs)) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a"), (3, "x"), (3, "x")]])
def test_odd_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as batch", "2 as bucket", "3 as kept")
    assert set(got(op.remove_repeats(df))) == {i for i, _ in rows if i is not None}

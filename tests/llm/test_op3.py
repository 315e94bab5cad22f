import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import op3_block_naming as op


def brute(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    return {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


def got(df):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()}


ROWS = [(1, "a  b"), (2, "a\n\tb"), (3, "a b "), (4, None), (5, ""), (6, "é" * 33), (7, "é" * 33), (8, "é" * 34), (9, "abcd" * 50), (10, "abcd" * 50), (11, "abcd" * 49 + "abce"), (12, "abcd" * 51)]


@pytest.mark.parametrize("block", [3, 4, 64])
def test_small(spark, block):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string").selectExpr("*", "1 as name", "2 as level", "3 as n")
    assert got(op.exact_groups(df, block)) == brute(ROWS)


def test_hash_clashes(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    done, _ = op.identities(df, 4, hashed=lambda c: F.length(c).cast("bigint"))
    names = {r.doc_id: (r.level, r["name"]) for r in done.collect()}
    want = brute(ROWS)
    assert all((names[a] == names[b]) == (want[a][0] == want[b][0]) for a in names for b in names)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a"), (3, "x"), (3, "x")]])
def test_odd_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(op.exact_groups(df)) == brute({i: (i, t) for i, t in rows if i is not None}.values())

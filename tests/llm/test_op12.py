import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import op12_hard_negatives as op

KIND = "vec_id bigint, label int, embedding array<float>"


def brute(rows, every=100):
    own = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own[i] = min(own.get(i, (label, v)), (label, v))
    own = {i: (l, [math.floor(256 * float(np.float32(x))) for x in v]) for i, (l, v) in own.items()}
    out = set()
    for a in own:
        if a % every:
            continue
        score = {b: max(-op.MOST, min(op.MOST, sum(x * y for x, y in zip(own[a][1], own[b][1])))) for b in own if b != a}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if own[b][0] == own[a][0]][:5]:
            low, high = 30 * score[p], 90 * score[p]
            found = [b for b in order if own[b][0] != own[a][0] and low <= 100 * score[b] <= high][:10]
            out |= {(a, p, r + 1, b, score[p], score[b]) for r, b in enumerate(found)}
    return out


def got(df, every=100):
    rows = [tuple(r) for r in op.mine(op.packed(df), F.col("vec_id") % every == 0).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_same_as_sql(spark, sf_small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_small}/embeddings.parquet'")
    want = con.execute(op.SQL)
    names = [d[0] for d in want.description]
    made = op.query(spark, sf_small)
    assert made.columns == names
    assert sorted(map(tuple, made.collect())) == sorted(want.fetchall())


def test_groups_and_blocks(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    rows = [(i, int(rnd.integers(0, 3)), [float(x) for x in rnd.integers(-4, 9, 6) / 16]) for i in range(700)]
    monkeypatch.setattr(op, "GROUP_BYTES", 300)
    monkeypatch.setattr(op, "CANDIDATE_ROWS", 37)
    monkeypatch.setattr(op, "ANCHOR_ROWS", 3)
    assert got(spark.createDataFrame(rows, KIND).repartition(5), 20) == brute(rows, 20)


def test_hot_vector(spark):
    """Two thirds of the rows are one vector, so scores tie in their hundreds."""
    rnd = random.Random(2)
    rows = [(i, rnd.choice([1, 1, 2]), [0.5, 0.25, 0.125] if i % 3 else [rnd.random() for _ in range(3)]) for i in range(900)]
    assert got(spark.createDataFrame(rows, KIND), 50) == brute(rows, 50)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, 0, [1.0])],
        [(0, 0, [1.0, 2.0])],
        [(None, 0, [1.0]), (0, None, [1.0]), (100, 1, None), (200, 1, [None, 1.0]), (300, 1, [float("nan")]), (400, 1, [float("inf")])],
        [(0, 1, [1.0, 1.0]), (0, 1, [1.0, 0.5]), (0, 0, [0.0, 1.0]), (1, 0, [0.5]), (2, 0, []), (3, 1, [0.1, 0.3]), (4, 1, [0.0, 0.2, 7.0]), (5, 2, [0.25, 0.25])],
        [(0, 0, [-1.0]), (1, 0, [1.0]), (2, 1, [0.5]), (100, 0, [0.0]), (3, 1, [0.0])],
        [(0, 0, [3e9, 1.0]), (1, 0, [3e9, 1.0]), (2, 1, [2e9, 3.0]), (3, 1, [2e9, 4.0]), (4, 1, [3e30, 1.0]), (100, 1, [1e-3, 1.0]), (101, 1, [1.0, 1.0]), (102, 0, [0.5, 0.5])],
    ],
)
def test_odd_tables(spark, rows):
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as vector", "2 as rank", "3 as anchor_id")
    assert got(df) == brute(rows)


def test_exact_beyond_doubles():
    a = np.array([[2.0**40 + 1, 3.0]])
    assert op.products(a, np.array([[2.0**20 + 1, 1.0]])).tolist() == [[(2**40 + 1) * (2**20 + 1) + 3]]
    assert op.products(a, a).tolist() == [[op.MOST]]

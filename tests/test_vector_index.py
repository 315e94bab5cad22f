import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from quillgraph.operators import retrieval, vector_index
from quillgraph.plans import registry


def frame(spark, x, name):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], f"{name} bigint, {'vec' if name == 'query_id' else 'embedding'} array<double>")


def brute(x, q, k, above=None):
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1)[:, None], out=np.zeros_like(m), where=np.linalg.norm(m, axis=1)[:, None] > 0)
    score = np.round(unit(q) @ unit(x).T, 12)
    out = {}
    for i, row in enumerate(score):
        order = [j for j in sorted(range(len(x)), key=lambda j: (-row[j], j)) if above is None or row[j] > above][:k]
        out[i] = [(j, row[j]) for j in order]
    return {i: v for i, v in out.items() if v}


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for i in a:
        assert [x for x, _ in a[i]] == [x for x, _ in b[i]] and all(math.isclose(x, y, abs_tol=1e-9) for (_, x), (_, y) in zip(a[i], b[i]))


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(1)
    heads = rng.normal(size=(40, 24))
    return np.vstack([heads[i % 40] + 0.15 * rng.normal(size=24) for i in range(3000)]), heads[:30] + 0.15 * rng.normal(size=(30, 24))


def test_reads_few_on_clusters(spark, clusters, monkeypatch):
    x, q = clusters
    monkeypatch.setattr(vector_index, "BLOCK", 50)
    index = vector_index.build(frame(spark, x, "chunk_id"), "chunk_id")
    found = vector_index.search(index, frame(spark, q, "query_id"), 10).collect()
    spark_rows = spark.createDataFrame(found)
    same(got(spark_rows), brute(x, q, 10))
    met = {r.query_id: r.met for r in found}
    assert sum(met.values()) < 0.5 * len(x) * len(q)
    same(got(spark_rows), got(retrieval.nearest(frame(spark, x, "chunk_id"), frame(spark, q, "query_id"), 10)))


def test_ties_zeros_and_small_tables(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([np.tile([1.0, 2.0, 0.0], (300, 1)), np.zeros((5, 3)), -np.tile([1.0, 2.0, 0.0], (4, 1)), rng.normal(size=(60, 3))])
    q = np.array([[2.0, 4.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 1.0], [-1.0, -2.0, 0.1]])
    for k, above in ((7, None), (350, None), (500, None), (20, 0.5)):
        index = vector_index.build(frame(spark, x, "chunk_id"), "chunk_id")
        same(got(vector_index.search(index, frame(spark, q, "query_id"), k, above)), brute(x, q, k, above))
    one = vector_index.build(frame(spark, x[:1], "chunk_id"), "chunk_id")
    same(got(vector_index.search(one, frame(spark, q, "query_id"), 3)), brute(x[:1], q, 3))
    none = vector_index.build(frame(spark, x, "chunk_id").filter("chunk_id < 0"), "chunk_id")
    assert vector_index.search(none, frame(spark, q, "query_id"), 3).count() == 0
    assert vector_index.search(one, frame(spark, q, "query_id").filter("query_id < 0"), 3).count() == 0


def test_within(spark, clusters):
    x, q = clusters
    index = vector_index.build(frame(spark, x, "chunk_id"), "chunk_id")
    found = {(r.query_id, r.chunk_id) for r in vector_index.within(index, frame(spark, q, "query_id"), 0.9).collect()}
    assert found == {(i, j) for i, v in brute(x, q, len(x), 0.9).items() for j, _ in v} and found


def test_within_of_many_cells(spark, monkeypatch):
    """Where no cell is ruled out a query is sent once to a group of cells, and in few rows at a time; values of ``same`` don't meet."""
    monkeypatch.setattr(vector_index, "BLOCK", 60)
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(700, 12)), np.tile(rng.normal(size=12), (150, 1)), np.zeros((3, 12))])
    kind = ["a" if i % 9 else "b" for i in range(len(x))]
    rows = spark.createDataFrame([(i, [float(v) for v in row], k) for i, (row, k) in enumerate(zip(x, kind))], "id bigint, unit array<double>, kind string")
    index = vector_index.build(rows, "id", "unit", same="kind")
    found = {(r.query_id, r.id) for r in vector_index.within(index, rows.selectExpr("id as query_id", "unit as vec", "kind"), 0.5).collect()}
    assert found == {(i, j) for i, v in brute(x, x, len(x), 0.5).items() for j, _ in v if kind[i] == kind[j]} and len(found) > 10_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(list(np.resize(x[:700], (3000, 12))), pa.list_(pa.float64())), pa.array(["a"] * 3000)], names=["query_id", "vec", "kind"])
    sent = list(vector_index._sent(index.cells, T.LongType(), 0.5, vector_index._groups(index), "kind")(iter([batch])))
    assert sum(b.num_rows for b in sent) <= 3000 * 2 * 853 / 60 and (index.cells.sizes > 0).sum() >= 25
    planned = vector_index._plan(index.cells, T.LongType(), None, -1.0, True)(iter([batch]))
    assert max(b.num_rows for b in planned) <= 4096


def test_query(spark, sf_small):
    rows = registry.QUERIES["vec_index_topk"](spark, sf_small).collect()
    want = registry.QUERIES["vec_topk_cosine"](spark, sf_small).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want)) and rows


def test_best_query_of_blocks(spark, monkeypatch):
    from quillgraph.operators import dense

    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(500, 4)), np.repeat(rng.normal(size=(60, 4)), 2, axis=0)
    monkeypatch.setattr(dense, "QUERY_BYTES", 500)
    found = {r.chunk_id: r.query_id for r in retrieval.best_query(frame(spark, x, "chunk_id"), frame(spark, q, "query_id"), above=0.1).collect()}
    score = np.round((x / np.linalg.norm(x, axis=1)[:, None]) @ (q / np.linalg.norm(q, axis=1)[:, None]).T, 10)
    assert found == {i: int(np.flatnonzero(row == row.max())[0]) for i, row in enumerate(score) if row.max() > 0.1}

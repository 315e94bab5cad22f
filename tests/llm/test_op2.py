import numpy as np

from quillgraph.llm import op2_target_mixing as op


def test_targets_and_posteriors(spark, sf_mid):
    docs, labels = (spark.read.parquet(f"{sf_mid}/{t}.parquet") for t in ("documents", "labels"))
    found = op.posteriors(docs, op.fit(docs, labels)).cache()
    steps, scale, out = op.fit_rates(found)
    rows = found.select("__words", *[f"__p_{d}" for d in op.DOMAINS], op._rate(steps).alias("r")).collect()
    x = np.array([tuple(r) for r in rows], float)
    assert (x[:, -1] >= 0).all()
    # The same descent on one machine.
    p, r = x[:, 1:4], np.ones(len(x))
    for s in steps:
        r = np.maximum(0, r - p @ s)
    assert np.allclose(r, x[:, -1], atol=1e-6)
    # The optimum: no rate can fall or rise (from 0: rise) to lower the squared differences.
    off = (x[:, 0] * x[:, -1]) @ p - out["targets"]
    assert np.allclose(off, out["after"] - out["targets"], atol=1)
    slope = p @ off / out["targets"].max()
    assert np.abs(slope[x[:, -1] > 1e-6]).max() < 2e-3 and slope.min() > -2e-3
    label = {r.doc_id: 2 if r.toxic else 1 if not r.quality else 0 for r in labels.collect()}
    pred = {r.doc_id: int(np.argmax([r[f"__p_{d}"] for d in op.DOMAINS])) for r in found.collect()}
    assert sum(pred[i] == k for i, k in label.items()) / len(label) > 0.8


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "x y z", None), (3, "x y z", None), (None, "q", "b")], "doc_id bigint, text string, quality string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    some = spark.createDataFrame([(3, 1, 0), (3, None, 0), (None, 1, 1), (2, 0, 0), (1, 0, 1)], "doc_id bigint, quality int, toxic int")
    for labels in (none, some):
        rows = op.mix(docs, labels).collect()
        assert len(rows) == 5 and all(r["__copies"] >= 1 for r in rows if not r.text)
        assert op.take(docs, labels).columns == docs.columns
    assert op.mix(docs.limit(0), some).count() == 0


def test_copies_meet_rates(spark, sf_mid):
    """The words that are taken meet those of the rates within the spread of an unbiased rounding."""
    docs, labels = (spark.read.parquet(f"{sf_mid}/{t}.parquet") for t in ("documents", "labels"))
    rows = op.mix(docs, labels).select("__words", "__rate", "__copies", *[f"__p_{d}" for d in op.DOMAINS]).collect()
    x = np.array([tuple(r) for r in rows], float)
    size, part = x[:, :1] * x[:, 3:], x[:, 1] - np.floor(x[:, 1])
    spread = np.sqrt((size**2 * (part * (1 - part))[:, None]).sum(0))
    assert (np.abs((x[:, 2] - x[:, 1]) @ size) <= 3 * spread).all()
    assert ((x[:, 2] == np.floor(x[:, 1])) | (x[:, 2] == np.ceil(x[:, 1]))).all()

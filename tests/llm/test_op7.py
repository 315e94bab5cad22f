import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from quillgraph.llm import op7_language_id as op


def test_held_out_accuracy(spark, sf_mid):
    rows = op.query(spark, sf_mid).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_mid}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in rows) / len(rows) < 0.01
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_tables(spark):
    rows = [(1, None, "en", 1), (2, "", "en", 1), (3, "123 --", None, 1), (4, "the cat and the dog", "en", 1), (6, "le chat et le chien", "fr", 1), (None, "the the", "en", 1), (4, "the cat and the dog", "en", 1), (7, "中文字 Ω", None, 2), (8, "the cat and the dog", "en", 1), (9, "le chat et le chien", "fr", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    kept = op.keep_identified(df)
    assert kept.columns == df.columns
    got = {r.doc_id: r.text for r in kept.collect()}
    assert {1, 2, 3}.isdisjoint(got) and {4, 6} <= set(got)
    named = op.annotate(df)
    assert named.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
    by = {r.text: r.lang_pred for r in named.collect()}
    assert by[None] == by[""] == by["123 --"] == "und" and by["le chat et le chien"] == "fr" and by["the the"] == "en"
    empty = op.annotate(df.limit(0))
    assert empty.count() == 0


def test_no_limit_from_outliers(spark, sf_mid):
    """No centroid is an outlier's own, whose limit would be 0."""
    _, langs, centres, far = op.fit(spark.read.parquet(f"{sf_mid}/documents.parquet"))
    assert len(langs) == len(centres) == len(far) and len(set(langs)) == 4
    assert (far > 0.3).all() and all(len({f for x, f in zip(langs, far) if x == k}) == 1 for k in langs)


def slot(gram):
    return ((gram[0] << 16 | gram[1] << 8 | gram[2]) * 2654435761 & 0xFFFFFFFF) >> (32 - op.BITS)


def brute(text, idf, langs, centres):
    """Nearest centroid of one text, gram by gram."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    folded = bytes((b + 32 if 65 <= b <= 90 else b) if b > 127 or chr(b).isalpha() else 32 for b in text.encode())
    weight = {k: math.log(1 + n) * float(idf[k]) for k, n in Counter(slot(folded[i : i + 3]) for i in range(len(folded) - 2)).items()}
    size = math.sqrt(sum(x * x for x in weight.values())) or 1.0
    cosine = [sum(x * float(c[k]) for k, x in weight.items()) / size for c in centres]
    best = max(range(len(langs)), key=lambda k: cosine[k])
    return langs[best], min(1.0, max(0.0, cosine[best]))


def test_against_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text", "lang")
    model = op.fit(docs)
    idf, langs, centres, _ = model
    for r in op.annotate(docs, model).collect():
        lang, score = brute(r.text, idf, langs, centres)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-6, r.doc_id


def test_own_centroid_is_kept(spark):
    """A text at no distance from its centroid isn't rejected by rounding, whatever the text."""
    rnd = np.random.default_rng(1)
    rows = [(k, "".join(chr(97 + x) for x in rnd.integers(0, 26, 30 + k)), f"l{k}") for k in range(60)]
    got = op.annotate(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    learned = {r.lang_pred for r in got}
    assert not any(r.rejected for r in got if r.lang in learned)


def test_centroids_hold_one_array():
    """Beside the vectors of a language's sample there are no arrays of their size."""
    rnd = np.random.default_rng(2)
    texts = ["".join(chr(97 + x) for x in rnd.integers(0, 26, 400)) for _ in range(op.SAMPLE_PER_LANGUAGE)]
    table = pa.table({"doc_id": range(len(texts)), "lang": ["a"] * len(texts), "text": texts})
    tracemalloc.start()
    try:
        op._centroids(np.ones(1 << op.BITS, np.float32))(table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1.5 * 8 * len(texts) * (1 << op.BITS)

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import common, kernels, op6_ngram_jaccard, op8_decontamination, op9_suffix_dedup
from tests.llm import test_op6, test_op9


def thue_morse(n, swap=False):
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def test_substrings():
    rnd = random.Random(1)
    data = np.frombuffer(bytes(rnd.choices(b"abc", k=3000)), np.uint8)
    prefix = kernels.prefix_hash(data)
    seen = {}
    for n in (1, 3, 400):
        start = np.arange(len(data) - n + 1)
        for i, h in zip(start, kernels.substring(prefix, start, start + n).tolist()):
            assert seen.setdefault(h, data[i : i + n].tobytes()) == data[i : i + n].tobytes()
    raws = set(seen.values())
    assert len(raws) == len(seen)


def test_rolling():
    data = np.frombuffer(b"abcabcabcabcabcabcabcabcxabcabcabcabcabcabcabcabcabc", np.uint8)
    for n in (1, 3, 8, 24, 31):
        own = kernels.rolling(data, n).tolist()
        raws = [data[i : i + n].tobytes() for i in range(len(data) - n + 1)]
        assert len(own) == len(raws) and len(set(zip(own, raws))) == len(set(raws)) == len(set(own))
    assert len(kernels.rolling(data[:5], 24)) == 0 and len(kernels.rolling(data[:24], 24)) == 1


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_structured_words(spark, n):
    """Words that collide under any base modulo a power of two."""
    one, two = thue_morse(n), thue_morse(n, True)
    raw = (one + " " + two).encode()
    assert len(set(kernels.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hash.tolist())) == 2
    rows = [(1, one), (2, two), (3, f"a b c d {one}"), (4, f"a b c d {two}"), (5, one + "x" * 500 + two)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert test_op6.got(op6_ngram_jaccard.components(df)) == test_op6.brute(rows)
    assert test_op9.got(op9_suffix_dedup.remove_repeats(df)) == test_op9.brute(rows)
    items = spark.createDataFrame([(1, one)], "item_id bigint, text string")
    hit = {r.doc_id for r in op8_decontamination.annotate(df, items).filter("__n_items > 0").collect()}
    assert 1 in hit and not hit & {2, 4}


def test_clashing_columns(spark, sf_small):
    """Callers' columns named like helper columns pass through the pipeline's stages unchanged."""
    import corpus_pipeline as pipe

    names = "rest none lang_pred score rejected __lang_pred __lang_score __words __p_clean __p_low __p_toxic __rate __copies __n_0 __n_items __item_0 __score_0 __best_item __best_score __kept_id component_id class_id n held_out text_sha256".split()
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    wide = docs.select("*", *[F.concat(F.lit(f"{n}:"), "doc_id").alias(n) for n in names])
    for _, stage in pipe.STAGES[:-1]:
        plain, more = common.cut(stage(spark, docs, sf_small)), common.cut(stage(spark, wide, sf_small))
        assert more.columns == wide.columns
        assert {r.doc_id for r in plain.collect()} == {r.doc_id for r in more.collect()}
        assert all(r[n] == f"{n}:{r.doc_id}" for r in more.collect() for n in names)
        docs, wide = plain, more
    assert pipe.STAGES[-1][1](spark, wide, sf_small).count() == wide.count()


def test_odd_rows_in_the_pipeline(spark, sf_small):
    """Nulls, repeated rows and rows that share a doc_id, by the rules of the pipeline's docstring."""
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    text = docs.filter("lang = 'en' and n_chars > 400").orderBy("doc_id").first().text
    odd = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "123 !?"), (None, text), (10**6 + 3, text[:200]), (10**6 + 3, text[:200])]
    more = spark.createDataFrame(odd, "doc_id bigint, text string").withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.lit(None).cast(docs.schema["n_chars"].dataType))
    own = docs.unionByName(more.select(*docs.columns))
    for _, stage in pipe.STAGES[:-1]:
        own = common.cut(stage(spark, own, sf_small))
    kept = [r.doc_id for r in own.collect()]
    assert None not in kept and not {10**6, 10**6 + 1, 10**6 + 2} & set(kept)
    assert kept.count(10**6 + 3) in (0, 2)
    made = pipe.STAGES[-1][1](spark, own, sf_small).collect()
    assert sorted(r.doc_id for r in made) == sorted(set(kept))

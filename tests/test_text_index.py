import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import tokens
from quillgraph.functions.stemming import STOP_WORDS, stem
from quillgraph.operators import retrieval, text_index


def test_blocks_as_exhaustive(spark, sf_mid):
    """The same 20 as by ranking everything for all benchmark items, from fewer postings."""
    docs, items = (spark.read.parquet(f"{sf_mid}/{t}.parquet") for t in ("documents", "benchmark"))
    asked = retrieval.query_lexemes(items.select(F.col("item_id").alias("query_id"), "text")).cache()
    index = text_index.build(docs, "doc_id", "text")
    found = text_index.search(index, asked, 20).collect()
    all_postings = retrieval.postings(docs, "doc_id", "text", only=asked)
    scored = retrieval.bm25(all_postings, asked, "doc_id", length=retrieval.lengths(docs, "doc_id", "text"))
    want = retrieval.ranked(scored.withColumn("score", F.round("score", text_index.DIGITS)), 20, "doc_id").collect()
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in found) == sorted((r.query_id, r["rank"], r.doc_id) for r in want)
    read = sum({r.query_id: r.read for r in found}.values())
    whole = all_postings.join(asked, "lexeme").count()
    assert read < 0.75 * whole


@pytest.mark.parametrize("english", [False, True])
def test_matches_where_the_chunks_are(spark, monkeypatch, english):
    """The chunks that a loop finds, in slices and blocks of any size, with ids that several chunks share, and no shuffle of words."""
    deal = random.Random(4)
    some = ["the", "Rains", "raining", "old", "houses", "house", "é", "12", "of"]
    rows = [(deal.randrange(60), " ".join(deal.choice(some) for _ in range(deal.randrange(14)))) for _ in range(90)] + [(None, "old house"), (None, "rains"), (99, None), (98, ""), (97, "...")]
    asked_of = {q: " ".join(deal.choice(some) for _ in range(deal.randrange(4))) for q in range(25)}
    form = lambda w: (None if w in STOP_WORDS else stem(w)) if english else w
    split = lambda x: [(i + 1, form(w)) for i, w in enumerate((x or "").lower().split()) if w != "..." and form(w)]
    own = {}
    for i, x in rows:
        for at, w in split(x):
            own.setdefault(i, {}).setdefault(w, []).append(at)
    want = {(q, i): sorted(sorted(places[w]) for w in {w for _, w in split(x)}) for q, x in asked_of.items() for i, places in own.items() if split(x) and all(w in places for _, w in split(x))}
    docs = spark.createDataFrame(rows, "chunk_id bigint, content string")
    asked = retrieval.query_lexemes(spark.createDataFrame(list(asked_of.items()), "query_id bigint, text string"), english)
    for words, pairs, size in ((1 << 20, 4 << 20, 16 << 20), (7, 40, 200)):
        monkeypatch.setattr(retrieval, "SLICE_WORDS", words)
        monkeypatch.setattr(retrieval, "SLICE_PAIRS", pairs)
        monkeypatch.setattr(retrieval, "ASKED_BYTES", size)
        found = retrieval.match_texts(docs, asked, english=english).collect()
        assert {(r.query_id, r.chunk_id): sorted(sorted(p) for p in r.positions) for r in found} == want and len(found) == len(want) > 50
        assert all(r.hits == sum(map(len, r.positions)) for r in found)
        listed = retrieval.postings(docs, english=english).collect()
        assert {(r.chunk_id, r.lexeme): list(r.positions) for r in listed} == {(i, w): sorted(p) for i, ws in own.items() for w, p in ws.items()} and len(listed) == sum(map(len, own.values()))
    once = docs.dropDuplicates(["chunk_id"])
    assert "Exchange" not in retrieval.postings(spark.range(5).selectExpr("id as chunk_id", "'a b' as content"))._jdf.queryExecution().executedPlan().toString()
    assert {(r.chunk_id, r.lexeme) for r in retrieval.postings(once).collect()} == {(r.chunk_id, w.lower()) for r in once.collect() for w in (r.content or "").split() if w != "..."}


@pytest.mark.parametrize("texts", [[], [None, "", "..."], ["a a b", "a", "c d", "b a", "a"]])
def test_small_tables(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (2, "zz"), (3, "c")], "query_id bigint, lexeme string")
    index = text_index.build(docs, "doc_id", "text", block=2)
    found = {(r.query_id, r["rank"]): r.doc_id for r in text_index.search(index, asked, 3).collect()}
    want = retrieval.ranked(retrieval.bm25(retrieval.postings(docs, "doc_id", "text"), asked, "doc_id").withColumn("score", F.round("score", 9)), 3, "doc_id")
    assert found == {(r.query_id, r["rank"]): r.doc_id for r in want.collect()}


def test_token_counts(spark, sf_small):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "日本語   \n x'll 12½"), (-4, "z" * 300)], "doc_id bigint, text string"))
    found = {r.doc_id: r.n_tokens for r in tokens.bpe_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "doc_id", "text").collect()}
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    assert found == {r.doc_id: len(own.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}


def test_windows_hold_no_texts(spark):
    """Context budgets and the digit gate sort lengths and flags; texts are brought together only where they fit."""
    from quillgraph.operators import assembly

    kind = "query_id bigint, chunk_id string, chunk_type string, score double, seq bigint, filename string, section_path string, content string"
    rows = [(q, f"c{i}", "DEFINITION" if i == 40 else None, [0.5, None, float("nan"), 0.9][i % 4], i, None if i == 8 else "f", "s", "x" * (i * 7)) for q in (1, 2, None) for i in range(1, 60)]
    own = spark.createDataFrame(rows, kind)
    found = {(r.query_id, r.chunk_id): r.pos for r in assembly.ordered_context(own).collect()}
    for q in (1, 2, None):
        of = sorted((r for r in rows if r[0] == q), key=lambda r: (r[2] != "DEFINITION", r[3] is None, r[3] == r[3], -(r[3] or 0) if r[3] == r[3] else 0, r[4]))
        used, want = 0, {}
        for pos, r in enumerate(of, 1):
            used += 0 if r[5] is None else len(f"[{r[1]}] (file: f, section: s)\n") + len(r[7]) + 2
            if used - 2 <= 8192:
                want[(q, r[1])] = pos
        assert {k: v for k, v in found.items() if k[0] == q} == want
    assert assembly.has_digits(own, order=(F.desc("score"), "chunk_id")).filter("not digits").count() == 3
    plan = assembly.has_digits(own)._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Window")[0] and "WindowGroupLimit" in plan


def test_words_are_counted_where_they_are():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([["b", "a", "b"], ["b"]]), pa.array([7, 8]), pa.array([3, 1], pa.int32())], names=["block", "words", "id", "length"])
    found = [tuple(r.values()) for b in text_index._counts("id")(iter([batch])) for r in b.to_pylist()]
    assert sorted(found) == [("a", 0, 7, 3, 1), ("b", 0, 7, 3, 2), ("b", 1, 8, 1, 1)]

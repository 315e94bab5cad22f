import re

import numpy as np

from quillgraph.llm import op8_decontamination as op


def plain_score(item, text):
    """Smith-Waterman cell by cell."""
    best, row = 0, [0] * (len(text) + 1)
    for a in item:
        new = [0]
        for j, b in enumerate(text, 1):
            new.append(max(0, row[j - 1] + (op.MATCH if a == b else op.MISMATCH), row[j] + op.GAP, new[-1] + op.GAP))
            best = max(best, new[-1])
        row = new
    return best


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())


def test_alignment():
    rng = np.random.default_rng(0)
    for _ in range(40):
        a, b = rng.integers(0, 6, rng.integers(1, 20)), rng.integers(0, 6, rng.integers(1, 40))
        assert op.smith_waterman(a, b) == plain_score(a, b)


def test_against_brute_force(spark, sf_small):
    docs, bench = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r.item_id, split(r.text)) for r in bench.collect()]
    want = set()
    for r in docs.collect():
        words = split(r.text)
        common = set(zip(words, words[1:], words[2:]))
        for _, w in items:
            if len(common & set(zip(w, w[1:], w[2:]))) >= 2 and plain_score(w, words) >= op.THRESHOLD * op.MATCH * len(w):
                want.add(r.doc_id)
    got = {r.doc_id for r in op.query(spark, sf_small).filter("contaminated").collect()}
    assert got == want and want


def test_edited_copies_and_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
    w = item.split()
    rows = [(1, None), (2, ""), (3, "the quick " + item.upper() + " end"), (4, " ".join(w[:6] + ["x"] + w[6:11] + ["y", "z"] + w[12:])), (5, " ".join(w[:5])), (6, " ".join(reversed(w))), (6, "q " + item), (None, item)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as item_id", "2 as n")
    bench = spark.createDataFrame([(7, item), (8, None), (None, item), (9, "two words"), (10, item)], "item_id bigint, text string")
    for block in (20_000, 1):
        kept = op.annotate(docs, bench, block)
        got = [(r.doc_id, r["__n_items"], r["__best_item"]) for r in kept.collect()]
        assert sorted(got, key=str) == sorted([(1, 0, None), (2, 0, None), (3, 2, 7), (4, 2, 7), (5, 0, None), (6, 0, None), (6, 2, 7), (None, 2, 7)], key=str)
    assert op.keep_clean(docs, bench).columns == docs.columns
    assert op.keep_clean(docs, bench.limit(0)).count() == len(rows)
    assert op.keep_clean(docs.limit(0), bench).count() == 0


def test_only_edited_copies(spark):
    """Grams that edits broke occur nowhere and must not be an item's rare seeds; nor may rarer ones of another copy hide a document."""
    w = [f"w{i}" for i in range(20)]
    other = [f"v{i}" for i in range(20)]
    fifth = [x if i % 5 != 4 else f"x{i}" for i, x in enumerate(w)]
    spaced = [x if i not in (4, 9, 14) else f"y{i}" for i, x in enumerate(w)]
    texts = [fifth, spaced[:15] + ["z"] + w[16:], other[:10] + ["a"] * 30, *[["b"] * 9 + other[10:]] * 5]
    docs = spark.createDataFrame([(i, " ".join(["q", *t])) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for one in ([0], [1], range(len(texts))):
        bench = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(other))], "item_id bigint, text string")
        got = {r.doc_id: r["__n_items"] for r in op.annotate(docs.filter(docs.doc_id.isin(list(one))), bench).collect()}
        want = {i: sum(plain_score(x, ["q", *texts[i]]) >= op.THRESHOLD * op.MATCH * len(x) for x in (w, other)) for i in one}
        assert got == want and all(want.values())


def test_short_items_and_blocks_of_bytes(spark):
    docs = spark.createDataFrame([(1, "Two  WORDS"), (2, "these are two words here"), (3, "one"), (4, "")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(9, "two words"), (10, "one"), (11, " "), (12, "are two words here and there")], "item_id bigint, text string")
    for limit in (op.BLOCK_BYTES, 8):
        got = {r.doc_id: (r["__n_items"], r["__best_item"]) for r in op.annotate(docs, bench, block_bytes=limit).collect()}
        assert got == {1: (1, 9), 2: (1, 12), 3: (1, 10), 4: (0, None)}

import re

import pytest

from quillgraph.llm import op6_ngram_jaccard as op


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_against_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(op.components(docs)) == brute(rows)


def test_near_groups(spark):
    import random

    rnd = random.Random(5)
    base = [f"w{rnd.randrange(400)}" for _ in range(120)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "two one"), (7, "a b c d e"), (8, "A b c d e f")]
    for k in range(40):
        w = list(base)
        for _ in range(k % 4):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        rows.append((100 + k, " ".join(w[: len(w) - k % 7])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(op.components(df)) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a b c d e f"), (3, "x"), (3, "x")]])
def test_odd_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n", "2 as tok", "3 as keys")
    assert set(got(op.components(df))) == {i for i, _ in rows if i is not None}


def test_all_links_of_a_group(spark):
    """Each class counts every other one that it is linked to, in a group of near copies too."""
    base = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])) for k in range(40)] + [(50, " ".join(base[:40])), (60, " ".join(base))]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    want = {i: sum(j != i and 100 * len(x & y) >= 80 * len(x | y) for j, y in sets.items()) for i, x in sets.items()}
    df = spark.createDataFrame(rows + [(99, rows[0][1])], "doc_id bigint, text string")
    got = {r.doc_id: r.class_links for r in op.components(df).collect()}
    assert got == want | {99: want[0]} and max(want.values()) == 40


def test_large_groups(spark, monkeypatch):
    """Lists and components beyond one block and one window give the same as brute force."""
    for name, value in (("SMALL", 3), ("LIST", 8), ("BLOCK", 7), ("BLOCK_KEYS", 500), ("SHUFFLED_ROUNDS", 1)):
        monkeypatch.setattr(op, name, value)
    import random

    rnd = random.Random(8)
    rows = []
    for g in range(3):
        base = [f"{g}w{i}" for i in range(60)]
        for k in range(30):
            w = list(base)
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
            rows.append((100 * g + k, " ".join(w)))
    common_run = "all of these share one run of words"
    rows += [(1000 + k, common_run + " " + " ".join(f"y{rnd.randrange(10**6)}" for _ in range(6))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = op.components(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows)
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, w in ((i, t.split()) for i, t in rows)}
    for r in found:
        x = sets[r.doc_id]
        assert r.class_links == sum(100 * len(x & y) >= 80 * len(x | y) for y in set(sets.values()) - {x})

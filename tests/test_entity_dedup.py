import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.config import EngineConfig
from quillgraph.operators import entity_dedup, graph
from quillgraph.plans import registry


def greedy(rows, similar):
    """Sequential rule: (type, place) in order; the first leader of the type that is similar."""
    heads, out = [], []
    for i, (kind, x) in enumerate(rows):
        own = next((h for h in heads if rows[h][0] == kind and similar(rows[h][1], x)), i)
        if own == i:
            heads.append(i)
        out.append(own)
    return out


def entities(spark, rows):
    kind = "seq bigint, name string, type string, confidence double, properties map<string,string>"
    return spark.createDataFrame([(i, n, t, (i * 7 % 10) / 10, {str(i % 3): str(i)}) for i, (t, n) in enumerate(rows)], kind)


@pytest.mark.parametrize("limit", [85.0, 70.0, 95.0, 60.0])
def test_names_as_one_by_one(spark, limit):
    rnd = random.Random(limit)
    stems = ["acme corporation", "global industries limited", "blue anvil", "smith john", "a", "ab", "abc", "north western railway company of america", "é界 ltd"]
    rows = []
    for _ in range(350):
        name = rnd.choice(stems)
        for _ in range(rnd.randrange(0, 4)):
            i = rnd.randrange(len(name) + 1)
            name = name[:i] + rnd.choice(["", "x", "e", " "]) + name[i + rnd.randrange(2) :]
        rows.append((rnd.choice("PQ"), name or "z"))
    exact = graph.dedup_entities(entities(spark, rows)).withColumn("names", F.array("name"))
    own = sorted(exact.collect(), key=lambda r: r.first_seq)
    heads = greedy([(r.type, r.norm_name) for r in own], lambda a, b: entity_dedup.token_sort_ratio(a, b) >= limit)
    want = {}
    for r, h in zip(own, heads):
        want.setdefault(h, []).append(r)
    got = {r.first_seq: r for r in entity_dedup.fuzzy_tier(exact, EngineConfig(fuzzy_threshold=limit)).collect()}
    assert len(got) == len(want)
    for members in want.values():
        r, best = got[members[0].first_seq], max(members, key=lambda m: (m.confidence, -m.first_seq))
        merged = {}
        for m in members:
            merged.update(m.properties)
        assert (r.name, r.type, r.confidence, r.names, r.properties) == (best.name, best.type, best.confidence, [n for m in members for n in m.names], merged)


def test_all_parts(spark, sf_small):
    """The registered query on every part, against the sequential rule."""
    parts = sorted(spark.read.parquet(f"{sf_small}/part.parquet").collect(), key=lambda r: r.p_partkey)
    seen = list(dict.fromkeys((r.p_brand, r.p_name) for r in parts))
    heads = greedy(seen, lambda a, b: entity_dedup.token_sort_ratio(a, b) >= EngineConfig().fuzzy_threshold)
    want = {}
    for (kind, name), h in zip(seen, heads):
        want.setdefault((kind, h), []).append(name)
    got = registry.QUERIES["entity_fuzzy_dedup"](spark, sf_small).collect()
    assert sorted((r.type, sorted(r.names.split(","))) for r in got) == sorted((k, sorted(v)) for (k, _), v in want.items())


def test_chain_of_neighbours(spark):
    """Each node is similar to the next only, so leaders wait for each other."""
    node = lambda i: (("t", i, str(i)),)
    kind = "struct<type:string,seq:bigint,key:string>"
    edges = spark.createDataFrame([(node(i)[0], node(i + 1)[0]) for i in range(8)] + [(node(0)[0], node(5)[0])], f"lo {kind}, hi {kind}")
    assert {r.node.seq: r.head.seq for r in entity_dedup.leaders(edges).collect()} == {1: 0, 3: 2, 5: 0, 7: 6}
    assert entity_dedup.leaders(edges.filter("lo.seq < 0")).count() == 0


def test_vectors_as_one_by_one(spark):
    rng = np.random.default_rng(4)
    heads = rng.normal(size=(25, 8))
    x = [heads[rng.integers(25)] + rng.choice([0, 0.1, 0.25]) * rng.normal(size=8) for _ in range(250)] + [np.zeros(8), np.zeros(8), None]
    kinds = [str(rng.integers(2)) for _ in x]
    rows = [(i, k, f"n{i}", None if v is None else [float(y) for y in v]) for i, (k, v) in enumerate(zip(kinds, x))]
    df = spark.createDataFrame(rows, "first_seq bigint, type string, name string, vector array<double>").selectExpr("*", "0.5 as confidence", "map('a', name) as properties", "array(name) as names")

    def similar(a, b):
        if a is None or b is None or not np.any(a) or not np.any(b):
            return False
        return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) >= EngineConfig().entity_cosine

    want = {}
    for i, h in enumerate(greedy(list(zip(kinds, x)), similar)):
        want.setdefault(h, []).append(f"n{i}")
    got = entity_dedup.vector_tier(df).collect()
    assert {r.first_seq: r.names for r in got} == want
    assert all(r.name == r.names[0] and len(r.properties) == 1 for r in got)


def test_grams_never_miss():
    """Two names that are similar share a gram of their prefixes, whatever the order of grams."""
    rnd = random.Random(8)
    for _ in range(3000):
        limit = rnd.choice([50.0, 70.0, 85.0, 95.0, 100.0])
        a = "".join(rnd.choices("abc ", k=rnd.randrange(1, 40))).strip() or "a"
        b = a
        for _ in range(rnd.randrange(0, 6)):
            i = rnd.randrange(len(b) + 1)
            b = b[:i] + rnd.choice(["", "a", "x"]) + b[i + rnd.randrange(2) :]
        b = b.strip() or "a"
        if 200.0 * entity_dedup.common_subsequence(a, b) / (len(a) + len(b)) < limit:
            continue
        order = lambda g: hash((g, 5))
        kept = []
        for name in (a, b):
            own = set()
            for size in "12":
                some = sorted(((g, p) for g, p in entity_dedup.grams(name, limit) if g[0] == size), key=lambda x: order(x[0]))
                own |= {g for g, _ in some[: some[0][1]]} if some else set()
            kept.append(own)
        assert kept[0] & kept[1], (a, b, limit)

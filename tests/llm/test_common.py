import random

from quillgraph.llm import common


def test_components(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rnd.randrange(100, 400), rnd.randrange(100, 400)) for _ in range(170)] + [(7, 7), (500, 499)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert got == want
    assert common.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_first_by_hash(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 = 0 as kind")
    got = common.first_by_hash(df, "kind", "id", 40).collect()
    order = {k: [r.id for r in df.filter(f"kind = {k}").selectExpr("id", "xxhash64(id) h").orderBy("h").limit(40).collect()] for k in (True, False)}
    assert {(r.kind, r.id) for r in got} == {(k, i) for k, ids in order.items() for i in ids}


def test_merge_components(spark):
    df = lambda edges: spark.createDataFrame(edges, "a bigint, b bigint")
    first, more = [(1, 2), (2, 3), (10, 11), (20, 21)], [(3, 11), (21, 5), (7, 8), (8, 7), (1, 3)]
    found = common.connected_components(df(first))
    rows = lambda x: sorted(map(tuple, x.select("node", "component").collect()))
    assert rows(common.merge_components(found, df(more))) == rows(common.connected_components(df(first + more)))
    assert rows(common.merge_components(found, df([]))) == rows(found)

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.config import EngineConfig
from quillgraph.operators import community, entity_dedup, graph
from quillgraph.operators import graph_learning as gl

ENTITY = "seq bigint, name string, type string, source_chunk_index int, source_document_id string, confidence double, properties map<string,string>"


def entities(spark, *rows):
    return spark.createDataFrame([(i, n, t, 0, "d", c, p) for i, (n, t, c, p) in enumerate(rows)], ENTITY)


def test_exact_tier(spark):
    got = graph.dedup_entities(entities(spark, ("Acme Corporation", "O", 0.8, {"a": "1"}), ("Acme Corporation", "O", 0.95, {"a": "2", "b": "3"}), ("acme corporation.", "O", 0.7, {"c": "4"}), ("Acme Corporation", "P", 0.1, {}))).collect()
    by = {r.type: r for r in got}
    assert len(got) == 2 and by["O"].confidence == 0.95 and by["O"].properties == {"a": "2", "b": "3", "c": "4"}


@pytest.mark.parametrize("a,b,n", [("Smith, John", "John Smith", 1), ("Acme Corporation", "Acme Corporations", 1), ("Acme Corporation", "Global Industries", 2)])
def test_fuzzy_tier(spark, a, b, n):
    got = entity_dedup.dedup_enhanced(entities(spark, (a, "P", 0.8, {}), (b, "P", 0.95, {}))).collect()
    assert len(got) == n and max(r.confidence for r in got) == 0.95


def test_vector_tier(spark):
    from pyspark.sql import functions as F

    own = graph.dedup_entities(entities(spark, ("CEO", "T", 0.8, {}), ("Chief Executive Officer", "T", 0.95, {}), ("Zebra", "T", 0.5, {}))).withColumn("names", F.array("name"))
    vec = F.when(F.col("name") == "CEO", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).when(F.col("name") == "Zebra", F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.99), F.lit(0.1), F.lit(0.0)))
    got = entity_dedup.vector_tier(own.withColumn("vector", vec)).collect()
    assert sorted(r.confidence for r in got) == [0.5, 0.95]


def test_relationships(spark):
    df = spark.createDataFrame([(0, "Acme Corporation", "John Smith", "EMPLOYS", 0.8), (1, "acme corporation", "john smith", "EMPLOYS", 0.95)], "seq bigint, source_entity string, target_entity string, type string, confidence double")
    names = spark.createDataFrame([("Acme Corporation", "O"), ("John Smith", "P")], "name string, type string")
    got = graph.dedup_relationships(df, names).collect()
    assert len(got) == 1 and got[0].confidence == 0.95 and got[0].source_entity == "Acme Corporation"


def tables(spark, nodes, edges):
    e = spark.createDataFrame([(n, "T", ["d"], i, s) for i, (n, s) in enumerate(nodes)], "name string, type string, source_document_ids array<string>, source_chunk_index int, status string")
    r = spark.createDataFrame([(str(i), a, "T", b, "T", k, c) for i, (a, b, k, c) in enumerate(edges)], "edge_id string, src_name string, src_type string, dst_name string, dst_type string, rel_type string, confidence double")
    return e, r


def test_traverse(spark):
    e, r = tables(spark, [("A", "active"), ("M", "deprecated"), ("B", "active"), ("C", "active")], [("A", "M", "R", 1.0), ("M", "B", "S", 1.0), ("A", "C", "R", 1.0), ("A", "C", "Q", 1.0)])
    seeds = spark.createDataFrame([("q", "a", 1)], "query_id string, name string, pos int")
    got = {x.name: (x.hop_weight, x.rel_types) for x in graph.traverse(seeds, e, r).collect()}
    # B over an inactive middle; C by its least type; A isn't reached from itself over parallel edges.
    assert got == {"B": (0.5, ["R", "S"]), "C": (1.0, ["Q"])}
    chunks = spark.createDataFrame([("c0", "d", 0), ("c2", "d", 2), ("c3", "d", 3)], "chunk_id string, document_id string, chunk_index int")
    found = {x.chunk_id: x.score for x in graph.resolve_chunks(graph.traverse(seeds, e, r), seeds, e, chunks).collect()}
    assert found == {"c3": 1.0, "c2": 0.5, "c0": 0.5}
    assert graph.resolve_chunks(graph.traverse(seeds, e, r).limit(0), seeds, e, chunks).count() == 0


def test_hubs(spark):
    edges = [("H", f"x{i}", "R", 1.0) for i in range(20)] + [("K", f"y{i}", "R", 1.0) for i in range(18)] + [("L", "z", "R", 1.0)]
    e, r = tables(spark, [(n, "active") for n in "HKL"], edges)
    pick = lambda *names: [x.name for x in graph.choose_seeds(spark.createDataFrame([("q", n, i) for i, n in enumerate(names)], "query_id string, name string, pos int"), e, r).collect()]
    assert pick("H", "L", "l") == ["L"] and pick("H", "K") == ["K"]


def test_merge(spark):
    e, r = tables(spark, [("A", "deprecated")], [])
    from pyspark.sql import functions as F

    old = e.withColumn("confidence", F.lit(0.9)).withColumn("properties", F.create_map(F.lit("k"), F.lit("v"))).withColumn("community_id", F.lit(1))
    new = spark.createDataFrame([("A", "T", "d2", 7, 0.5, {})], "name string, type string, source_document_id string, source_chunk_index int, confidence double, properties map<string,string>")
    x = graph.merge_entities(old, new).first()
    assert (x.source_document_ids, x.source_chunk_index, x.confidence, x.properties, x.status) == (["d", "d2"], 0, 0.9, {}, "active")
    again = graph.merge_entities(graph.merge_entities(old, new), new).collect()
    assert len(again) == 1 and again[0].source_document_ids == ["d", "d2"]
    rel = spark.createDataFrame([("A", "A", "R", "d2", 1, 0.5, {}), ("A", "?", "R", "d2", 1, 0.5, {})], "source_entity string, target_entity string, type string, source_document_id string, source_chunk_index int, confidence double, properties map<string,string>")
    empty = spark.createDataFrame([], "edge_id string, src_name string, src_type string, dst_name string, dst_type string, rel_type string, source_document_id string, source_chunk_index int, confidence double, properties map<string,string>")
    assert graph.merge_relationships(empty, rel, old).count() == 1


def test_communities(spark):
    e, r = tables(spark, [(n, "active") for n in "abcdef"], [("a", "b", "R", 1.0), ("c", "d", "R", 1.0), ("e", "e", "R", 1.0)])
    edges = community.undirected(graph.active_edges(e, r))
    assert edges.count() == 2
    from pyspark.sql import functions as F

    got = {x.node: x.community_id for x in community.detect(edges, e.select(F.concat_ws("::", "name", "type").alias("node"))).collect()}
    assert got["a::T"] == got["b::T"] != got["c::T"] == got["d::T"] and len(set(got.values())) == 4


def test_partition_beats_components():
    rng = np.random.default_rng(0)
    pairs = {(int(min(a, b)), int(max(a, b))) for g in range(4) for a, b in rng.integers(g * 8, g * 8 + 8, (40, 2)) if a != b} | {(g * 8, (g + 1) * 8) for g in range(3)}
    a, b = np.array(sorted(pairs)).T
    own = community.partition(32, a, b, np.ones(len(a)), 1.0, 42)
    edges = [(x, y, 1.0) for x, y in zip(a.tolist(), b.tolist())]
    assert community.modularity(dict(enumerate(own)), edges) > 0.6
    assert (own == community.partition(32, a, b, np.ones(len(a)), 1.0, 42)).all() and len(set(own)) == 4


def test_sage(spark):
    x = np.random.default_rng(0).normal(size=(5, 16))
    model = gl.train_sage(x, np.array([[0, 1], [1, 2], [3, 4]]), EngineConfig(train_epochs=5, sage_dims=(16, 8, 8)))
    nodes = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "node string, x array<double>")
    for edges in ([("0", "1"), ("1", "2"), ("3", "4")], [("0", "0")]):
        got = gl.infer_sage(nodes, spark.createDataFrame(edges, "a string, b string"), model.params).collect()
        assert len(got) == 5 and all(len(r.embedding) == 8 and abs(sum(v * v for v in r.embedding) - 1) < 1e-6 for r in got)


def test_transe(spark):
    one = spark.createDataFrame([("A", "R", "B")], "h string, r string, t string")
    ent, rel = gl.transe(one, 16, EngineConfig(train_epochs=300))
    v = {r.node: np.array(r.embedding) for r in ent.collect()}
    assert np.linalg.norm(v["A"] + np.array(rel.first().embedding) - v["B"]) < 1.5
    assert all(abs(np.linalg.norm(x) - 1) < 1e-6 for x in v.values())
    ent, rel = gl.transe(one.limit(0), 16)
    assert ent.count() == 0 == rel.count()


def test_fuzzy_query_takes_all_parts(spark, tmp_path):
    """Parts of any key are merged, as by brute force over all pairs in order."""
    rng = np.random.default_rng(3)
    words = "almond antique azure beige black blue".split()
    rows = [(300 + 7 * i, " ".join(rng.choice(words, 4)) + ["", " x", " yz"][i % 3], f"b{i % 2}", i % 50) for i in range(90)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    from quillgraph.plans import registry

    first: dict = {}
    for _, name, brand, _ in rows:
        first.setdefault((brand, name), name)
    groups: dict = {}
    for brand, name in first:
        heads = groups.setdefault(brand, {})
        head = next((h for h in heads if entity_dedup.token_sort_ratio(h, name) >= EngineConfig().fuzzy_threshold), name)
        heads.setdefault(head, []).append(name)
    got = sorted((r.type, r.names) for r in registry.QUERIES["entity_fuzzy_dedup"](spark, str(tmp_path)).collect())
    assert got == sorted((b, ",".join(n)) for b, heads in groups.items() for n in heads.values())
    assert any("," in n for _, n in got)


def test_graph_queries_take_all_edges(spark, sf_small):
    from quillgraph.plans import registry

    customers = {f"{r.c_name}::Customer" for r in spark.read.parquet(f"{sf_small}/customer.parquet").filter("c_custkey % 11 <> 0").collect()}
    for name, column in (("leiden", "node"), ("sage_embeddings", "node"), ("transe_embeddings", "name")):
        got = {r[column] for r in registry.QUERIES[name](spark, sf_small).collect()}
        assert customers and customers <= got


def test_training_takes_all_edges(spark):
    rows = [(f"n{i}", "RS"[i % 2], f"n{(i * 7 + 1) % 40}") for i in range(30) if i != (i * 7 + 1) % 40]
    triples = spark.createDataFrame(rows, "h string, r string, t string")
    names = {x for h, _, t in rows for x in (h, t)}
    ent, rel = gl.transe(triples, 8, EngineConfig(train_epochs=2), bucket_entities=15, passes=1)
    assert {r.node for r in ent.collect()} == names and rel.count() == 2
    edges = triples.selectExpr("h as a", "t as b")
    nodes = ent.selectExpr("node", "embedding as x")
    config = EngineConfig(train_epochs=2, sage_dims=(8, 4, 4))
    batches = gl.minibatches(nodes, edges, config, parts=2)
    assert batches.groupBy("epoch").count().filter(f"count = {len(rows)}").count() == 2
    found, _ = gl.sage(nodes, edges, config)
    assert found.count() == nodes.count()


def test_matchings():
    for n in range(1, 9):
        rounds = gl.matchings(n)
        met = [p for r in rounds for p in r]
        assert sorted(met) == [(i, j) for i in range(n) for j in range(i, n)]
        assert all(len({b for p in r for b in p}) == sum(len(set(p)) for p in r) for r in rounds)


def test_translations_of_buckets(spark):
    """The margin loss falls in buckets about as far as on one machine, and each entity has one vector."""
    rng = np.random.default_rng(6)
    place = rng.normal(size=(60, 2))
    step = {"R": np.array([1.0, 0.0]), "S": np.array([0.0, 1.0])}
    rows = [(f"n{i:02d}", r, f"n{int(np.argmin(((place[i] + v - place) ** 2).sum(1) + 9 * (np.arange(60) == i))):02d}") for i in range(60) for r, v in step.items()]
    triples = spark.createDataFrame(rows, "h string, r string, t string")

    def loss(ent, rel):
        total = 0.0
        for k, (h, r, t) in enumerate(rows):
            other = f"n{(k * 17 + 5) % 60:02d}"
            if other in ent:
                total += max(0.0, 1 + np.linalg.norm(ent[h] + rel[r] - ent[t]) - np.linalg.norm(ent[h] + rel[r] - ent[other]))
        return total / len(rows)

    got = []
    for epochs, size in ((1, 25), (120, 25), (120, 1000)):
        ent, rel = gl.transe(triples, 12, EngineConfig(train_epochs=epochs, margin=1.0), bucket_entities=size, passes=2)
        rows_of = ent.collect()
        ent = {r.node: np.array(r.embedding) for r in rows_of}
        assert len(rows_of) == len(ent) == len({x for h, _, t in rows for x in (h, t)})
        got.append(loss(ent, {r.relation_type: np.array(r.embedding) for r in rel.collect()}))
    assert got[1] < 0.8 * got[0] and got[1] < 1.35 * got[2], got


def test_minibatch_weights(spark):
    """Weights equal those of one machine on the same batches, whose gradient is that of the loss."""
    rng = np.random.default_rng(7)
    nodes = spark.createDataFrame([(f"v{i:02d}", rng.normal(size=6).tolist()) for i in range(40)], "node string, x array<double>")
    edges = spark.createDataFrame([(f"v{int(a):02d}", f"v{int(b):02d}") for a, b in rng.integers(0, 40, (90, 2))] + [("v00", f"v{i:02d}") for i in range(1, 40)], "a string, b string")
    config = EngineConfig(train_epochs=4, sage_dims=(6, 5, 4), negatives=2, sage_neighbours=3, learning_rate=0.05)
    batches = gl.minibatches(nodes, edges, config, batch_edges=40, parts=3)
    params, losses = gl.train_on(batches, 6, config)
    rows = batches.collect()
    own = gl.Sage((6, 5, 4), config.seed).params
    one, two = ({k: np.zeros_like(v) for k, v in own.items()} for _ in range(2))
    for epoch in range(1, 5):
        grads, pairs = {k: 0.0 for k in own}, 0
        for part in sorted({r.part for r in rows if r.epoch == epoch}):
            some = sorted((r for r in rows if r.epoch == epoch and r.part == part), key=lambda r: r.edge)
            g, loss, n = gl.sage_gradient(own, [r.a for r in some], [r.b for r in some], 2)
            pairs += n
            grads = {k: grads[k] + g[k] for k in g}
            if epoch == 1 and part == min(r.part for r in rows):
                for k, at in (("own0", (1, 2)), ("near0", (3, 0)), ("own1", (2, 3)), ("near1", (4, 1))):
                    more = {x: v.copy() for x, v in own.items()}
                    more[k][at] += 1e-6
                    slope = (gl.sage_gradient(more, [r.a for r in some], [r.b for r in some], 2)[1] - loss) / 1e-6
                    assert abs(slope - g[k][at]) < 1e-3 * max(1, abs(slope))
        for k in own:
            g = grads[k] / pairs
            one[k] = 0.9 * one[k] + 0.1 * g
            two[k] = 0.999 * two[k] + 0.001 * g * g
            own[k] = own[k] - 0.05 * (one[k] / (1 - 0.9**epoch)) / (np.sqrt(two[k] / (1 - 0.999**epoch)) + 1e-8)
    assert len(losses) == 4 and all(np.abs(own[k] - params[k]).max() < 1e-6 for k in own)
    assert all(2 <= len(r.a) <= 4 and len(r.a[0]) == 12 for r in rows)


def planted(seed, groups, size, degree):
    rng = np.random.default_rng(seed)
    n = groups * size
    a = rng.integers(0, n, n * degree)
    b = np.where(rng.random(len(a)) < 0.8, a // size * size + rng.integers(0, size, len(a)), rng.integers(0, n, len(a)))
    pairs = sorted({(int(min(x, y)), int(max(x, y))) for x, y in zip(a, b) if x != y})
    return n, [(x, y, 1.0) for x, y in pairs]


def connected(labels, edges):
    root = {x: x for x in labels}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _ in edges:
        if labels[a] == labels[b]:
            root[find(a)] = find(b)
    return len({find(x) for x in labels}) == len(set(labels.values()))


def test_partition_refines():
    """At least the modularity that moves and splitting alone gave on these graphs, and connected communities."""
    for seed, least in ((0, 0.60), (1, 0.60), (2, 0.60)):
        n, edges = planted(seed, 12, 25, 4)
        a, b, w = (np.array(c) for c in zip(*edges))
        labels = dict(enumerate(community.partition(n, a, b, w, 1.0, 42).tolist()))
        assert community.modularity(labels, edges) > least and connected(labels, edges)


def test_one_component_by_many_tasks(spark):
    n, edges = planted(5, 5, 20, 4)
    name = lambda i: f"n{i:04d}"
    df = spark.createDataFrame([(name(a), name(b), w) for a, b, w in edges], "a string, b string, weight double").repartition(4)
    named, r = [(name(a), name(b), w) for a, b, w in edges], EngineConfig().community_resolution
    found = {x.node: x.community_id for x in community.detect(df, None, EngineConfig(), 120).collect()}
    sizes = [sum(v == k for v in found.values()) for k in range(len(set(found.values())))]
    assert len(found) == n and sizes == sorted(sizes, reverse=True) and connected(found, named)
    a, b, w = (np.array(c) for c in zip(*edges))
    alone = dict(enumerate(community.partition(n, a, b, w, r, 42).tolist()))
    assert community.modularity(found, named, r) > 0.95 * community.modularity(alone, edges, r)


def brute_paths(live, edges, seeds, most):
    """All paths of one or two edges, in the order of the rule."""
    near = {}
    for k, (a, b, rel) in enumerate(edges):
        near.setdefault(a, []).append((k, b, rel))
        if a != b:
            near.setdefault(b, []).append((k, a, rel))
    best = {}
    for s in seeds:
        for k, m, rel in near.get(s, []):
            for w, t, rels in [(1.0, m, [rel])] + [(0.5, t, [rel, r]) for k2, t, r in near.get(m, []) if k2 != k]:
                if t in live and t != s:
                    best[s, t] = min(best.get((s, t), (0, [])), (-w, rels))
    order = sorted(best, key=lambda p: (best[p][0], p))[:most]
    return [(s, t, -best[s, t][0], best[s, t][1]) for s, t in order]


def test_paths_as_brute_force(spark):
    rng = np.random.default_rng(11)
    for most, n, m in ((5, 14, 30), (30, 60, 90), (3, 8, 25)):
        names = [f"n{i:02d}" for i in range(n)]
        edges = [(names[a], names[b], "RST"[k]) for a, b, k in zip(rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 3, m))]
        live = [x for x in names if rng.random() < 0.7]
        seeds = live[:3]
        e, r = tables(spark, [(x, "active" if x in live else "deprecated") for x in names], [(a, b, k, 1.0) for a, b, k in edges])
        asked = spark.createDataFrame([("all", s, i) for i, s in enumerate(seeds)] + [("one", seeds[-1], 0)], "query_id string, name string, pos int")
        got = graph.traverse(asked, e, r, EngineConfig(max_paths=most)).collect()
        for q, own in (("all", seeds), ("one", seeds[-1:])):
            found = sorted(((x.seed_name, x.name, x.hop_weight, x.rel_types) for x in got if x.query_id == q), key=lambda x: (-x[2], x[0], x[1]))
            assert found == brute_paths(set(live), edges, own, most)


def test_hub_in_the_middle(spark):
    """A middle of 100,000 edges offers a bounded number of names."""
    names = spark.range(100_000).select(F.format_string("x%06d", "id").alias("name"), F.lit("T").alias("type"), F.lit("active").alias("status"))
    e = names.unionByName(spark.createDataFrame([("S", "T", "active"), ("H", "T", "deprecated")], "name string, type string, status string"))
    r = names.select(F.concat(F.lit("e"), "name").alias("edge_id"), F.lit("H").alias("src_name"), F.lit("T").alias("src_type"), F.col("name").alias("dst_name"), F.col("type").alias("dst_type"), F.lit("R").alias("rel_type"))
    r = r.unionByName(spark.createDataFrame([("e", "S", "T", "H", "T", "Q")], r.schema))
    one = spark.createDataFrame([("q", "S", "T", "e", "H", "T", ["Q"])], "query_id string, s_name string, s_type string, edge_id string, b_name string, b_type string, rel_types array<string>")
    live = e.filter("status = 'active'").select("name", "type")
    near = spark.createDataFrame([("q", 0)], "query_id string, have int")
    assert graph.second_hops(one, near, graph.both_ways(r), live, 30).count() == 61
    got = graph.traverse(spark.createDataFrame([("q", "s", 0)], "query_id string, name string, pos int"), e, r).collect()
    assert sorted(x.name for x in got) == [f"x{i:06d}" for i in range(30)] and all(x.rel_types == ["Q", "R"] for x in got)


def test_seeds_that_take_all_are_not_ranked(spark, monkeypatch):
    """Seeds with one middle go as a whole where their query can't have too many paths, with the same rows."""
    rng, chosen = np.random.default_rng(5), graph.second_hops
    asked_for = []
    monkeypatch.setattr(graph, "second_hops", lambda one, *rest: asked_for.append({r["s_name"] for r in one.collect()}) or chosen(one, *rest))
    for most in (10**9, 40, 6):
        names = [f"n{i:02d}" for i in range(40)]
        edges = [(f"n{i:02d}", f"n{i % 4:02d}", "RST"[k]) for i, k in zip(range(40), rng.integers(0, 3, 40))] + [("n08", "n00", "A"), ("n09", "n02", "Q"), ("n10", "n10", "A"), ("n11", "n30", "S")]
        live = [x for x in names if x not in ("n01", "n20")]
        seeds = ["n08", "n09", "n10", "n11", "n13", "n30", "n03"]
        e, r = tables(spark, [(x, "active" if x in live else "deprecated") for x in names], [(a, b, k, 1.0) for a, b, k in edges])
        asked = spark.createDataFrame([("all", s, i) for i, s in enumerate(seeds)] + [(s, s, 0) for s in seeds], "query_id string, name string, pos int")
        got = graph.traverse(asked, e, r, EngineConfig(max_paths=most)).collect()
        for q, own in [("all", seeds)] + [(s, [s]) for s in seeds]:
            found = sorted(((x.seed_name, x.name, x.hop_weight, x.rel_types) for x in got if x.query_id == q), key=lambda x: (-x[2], x[0], x[1]))
            assert found == brute_paths(set(live), edges, own, most)
    assert not asked_for[0] & {"n08", "n13"} and {"n09", "n11"} <= asked_for[0]
    assert {"n08", "n13"} <= asked_for[2]


def test_translations_touch_what_moves(monkeypatch):
    """A minibatch costs no more where the bucket holds more entities."""
    import numpy as np

    from quillgraph.operators import graph_learning as gl

    rows, unit = [], gl._unit
    monkeypatch.setattr(gl, "_unit", lambda x: rows.append(len(x)) or unit(x))
    rng = np.random.default_rng(1)
    triples = np.stack([rng.integers(0, 20_000, 5120), np.zeros(5120, int), rng.integers(0, 20_000, 5120)], 1)
    ent, _ = gl._translate(rng.normal(size=(20_000, 4)), rng.normal(size=(1, 4)), triples, 2, gl.EngineConfig(), rng)
    assert sum(rows) <= 20_000 * 3 + 2 * 4 * 5120
    assert np.allclose(np.linalg.norm(ent, axis=1), 1)

"""Names by parts and searches over the graph, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph

ENTITY = "name string, type string, status string, source_document_ids array<string>, source_chunk_index int"


def entities(spark, names):
    return spark.createDataFrame([(n, "T", "active", ["d"], i) for i, n in enumerate(names)], ENTITY)


def test_match_names_equals_a_loop(spark):
    deal = random.Random(3)
    word = lambda n: "".join(deal.choice("abÀ c.%_\\") for _ in range(n))
    names = list(dict.fromkeys([word(deal.randrange(9)) for _ in range(150)] + ["Straße", "HOT hot HOT"] + [f"hot {i}" for i in range(60)]))
    wanted = list(dict.fromkeys([word(deal.randrange(6)) for _ in range(80)] + ["hot", "HOT 1", "zzz", "ß", ""]))
    rows = [(q, w) for q in (1, 2) for w in wanted] + [(3, None), (3, "hot"), (3, "hot")]
    own = entities(spark, names).unionByName(spark.createDataFrame([("hot 0 gone", "T", "deprecated", [], 0), (None, "T", "active", [], 0)], ENTITY))
    got = sorted((r.query_id, r.wanted, r.name) for r in graph.match_names(spark.createDataFrame(rows, "query_id long, name string"), own).collect())
    want = sorted((q, w, n) for q, w in rows if w is not None for n in sorted(x for x in names if w.lower() in x.lower())[:3])
    assert got == want and len(want) > 100


def shuffled(plan):
    """Records that each exchange of an executed plan has written."""
    found = [plan.metrics().get("shuffleRecordsWritten").get().value()] if plan.nodeName() == "Exchange" and plan.metrics().contains("shuffleRecordsWritten") else []
    inner = [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in plan.nodeName() else [plan.children().apply(i) for i in range(plan.children().size())]
    return found + [n for x in inner for n in shuffled(x)]


def test_parts_that_most_names_have_are_not_shuffled(spark):
    own = spark.range(0, 4000, 1, 4).select(F.format_string("Customer#%09d", "id").alias("name"), F.lit("T").alias("type"), F.lit("active").alias("status"))
    names = spark.createDataFrame([(1, "customer#000000007"), (2, "#000003999")], "query_id long, name string")
    found = graph.match_names(names, own)
    assert sorted((r.query_id, r.name) for r in found.collect()) == [(1, "Customer#000000007"), (2, "Customer#000003999")]
    # Without that, each name went out once for each common part.
    assert max(shuffled(found._jdf.queryExecution().executedPlan()), default=0) < 4000


def test_query_asks_for_short_parts_too(spark, sf_small):
    from quillgraph.plans import registry

    found = {(r.wanted, r.name) for r in registry.QUERIES["fuzzy_name_contains"](spark, sf_small).collect()}
    nations = [r.n_name for r in spark.read.parquet(f"{sf_small}/nation.parquet").collect()]
    assert all(any(w == part for w, _ in found) for n in nations for part in (n.lower(), n[:2].lower()))


def test_match_names_of_nothing(spark):
    none = spark.createDataFrame([], "query_id long, name string")
    assert graph.match_names(none, entities(spark, ["a"])).count() == 0
    assert graph.match_names(spark.createDataFrame([(1, "a")], none.schema), entities(spark, [])).count() == 0


def test_find_seeds(spark):
    own = entities(spark, ["Acme", "Acme Two", "Beta"])
    near = spark.createDataFrame([(1, "Acme", 1), (2, "Beta", 1), (2, "Acme", 2)], "query_id long, name string, rank int")
    wanted = spark.createDataFrame([(1, "acme"), (2, "acme"), (3, "beta"), (4, "none"), (3, "beta")], "query_id long, name string")
    got = {tuple(r) for r in graph.find_seeds(near, wanted, own).select("query_id", "name", "pos").collect()}
    # A name that is near already keeps its place; its turn among the named ones stays empty.
    assert got == {(1, "Acme", 1), (1, "Acme Two", 3), (2, "Beta", 1), (2, "Acme", 2), (3, "Beta", 1)}


@pytest.mark.parametrize("hub", [False, True])
def test_search(spark, hub):
    names = ["Acme", "Beta", "Rome"] + [f"n{i}" for i in range(20)]
    edges = [("Acme", "Rome"), ("Beta", "Rome")] + ([("Acme", f"n{i}") for i in range(20)] if hub else [])
    rel = spark.createDataFrame([(f"{a}-{b}", a, "T", b, "T", "IN") for a, b in edges], "edge_id string, src_name string, src_type string, dst_name string, dst_type string, rel_type string")
    near = spark.createDataFrame([], "query_id string, name string, rank int")
    wanted = spark.createDataFrame([("q", "acme"), ("q", "beta")], "query_id string, name string")
    chunks = spark.createDataFrame([("d", i, f"c{i}") for i in range(3)], "document_id string, chunk_index int, chunk_id string")
    seeds, paths, found = graph.search(near, wanted, entities(spark, names), rel, chunks)
    assert {r.name for r in seeds.collect()} == ({"Beta"} if hub else {"Acme", "Beta"})
    assert {(r.seed_name, r.name) for r in paths.collect() if r.name in ("Acme", "Beta", "Rome")} == ({("Beta", "Rome"), ("Beta", "Acme")} if hub else {("Acme", "Rome"), ("Acme", "Beta"), ("Beta", "Rome"), ("Beta", "Acme")})
    assert {r.chunk_id for r in found.collect()} == {"c0", "c1", "c2"}

"""Queries on a knowledge graph derived from the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.config import EngineConfig
from quillgraph.operators import community, entity_dedup, graph, graph_learning, retrieval
from quillgraph.plans.registry import query


def _entities(t):
    """Customers, suppliers, nations and regions; every 11th customer is deprecated."""
    customer = t("customer").select(F.col("c_name").alias("name"), F.lit("Customer").alias("type"), F.array((F.col("c_custkey") % 100).cast("string"), F.lit("x")).alias("source_document_ids"), (F.col("c_custkey") % 9).cast("int").alias("source_chunk_index"), F.when(F.col("c_custkey") % 11 == 0, "deprecated").otherwise("active").alias("status"))
    supplier = t("supplier").select(F.col("s_name").alias("name"), F.lit("Supplier").alias("type"), F.array((F.col("s_suppkey") % 100).cast("string")).alias("source_document_ids"), (F.col("s_suppkey") % 9).cast("int").alias("source_chunk_index"), F.lit("active").alias("status"))
    nation = t("nation").select(F.col("n_name").alias("name"), F.lit("Nation").alias("type"), F.array(F.lit("n")).alias("source_document_ids"), F.col("n_nationkey").cast("int").alias("source_chunk_index"), F.lit("active").alias("status"))
    region = t("region").select(F.col("r_name").alias("name"), F.lit("Region").alias("type"), F.array(F.lit("r")).alias("source_document_ids"), F.lit(None).cast("int").alias("source_chunk_index"), F.lit("active").alias("status"))
    return customer.unionByName(supplier).unionByName(nation).unionByName(region)


def _edges(t):
    nation = t("nation")
    c = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("src_name"), F.lit("Customer").alias("src_type"), F.col("n_name").alias("dst_name"), F.lit("Nation").alias("dst_type"), F.lit("LIVES_IN").alias("rel_type"), (F.col("c_custkey") % 10 / 10).alias("confidence"))
    s = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("src_name"), F.lit("Supplier").alias("src_type"), F.col("n_name").alias("dst_name"), F.lit("Nation").alias("dst_type"), F.lit("LOCATED_IN").alias("rel_type"), F.lit(None).cast("double").alias("confidence"))
    n = nation.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src_name"), F.lit("Nation").alias("src_type"), F.col("r_name").alias("dst_name"), F.lit("Region").alias("dst_type"), F.lit("PART_OF").alias("rel_type"), F.lit(1.0).alias("confidence"))
    return c.unionByName(s).unionByName(n).withColumn("edge_id", graph.edge_id("src_name", "rel_type", "dst_name"))


def _seeds(t):
    """Every supplier whose key is divisible by 50 as a query of its own, and the regions as one, in another case."""
    s = t("supplier").filter("s_suppkey % 50 = 0").select(F.col("s_suppkey").cast("long").alias("query_id"), F.upper("s_name").alias("name"), F.col("s_suppkey").cast("long").alias("pos"))
    r = t("region").select(F.lit(0).cast("long").alias("query_id"), F.lower("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("pos"))
    return s.unionByName(r)


ENTITIES = """e AS (SELECT c_name AS name, 'Customer' AS type, [CAST(c_custkey % 100 AS VARCHAR), 'x'] AS docs, CAST(c_custkey % 9 AS BIGINT) AS idx, CASE WHEN c_custkey % 11 = 0 THEN 'deprecated' ELSE 'active' END AS status FROM customer
 UNION ALL SELECT s_name, 'Supplier', [CAST(s_suppkey % 100 AS VARCHAR)], s_suppkey % 9, 'active' FROM supplier UNION ALL SELECT n_name, 'Nation', ['n'], n_nationkey, 'active' FROM nation UNION ALL SELECT r_name, 'Region', ['r'], NULL, 'active' FROM region)"""
EDGES = """g AS (SELECT c_name AS src, 'Customer' AS st, n_name AS dst, 'Nation' AS dt, 'LIVES_IN' AS rel, c_custkey % 10 / 10.0 AS confidence FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT s_name, 'Supplier', n_name, 'Nation', 'LOCATED_IN', NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT n_name, 'Nation', r_name, 'Region', 'PART_OF', 1.0 FROM nation JOIN region ON n_regionkey = r_regionkey)"""
BOTH = "b AS (SELECT src AS a, st AS at, dst AS z, dt AS zt, rel FROM g UNION ALL SELECT dst, dt, src, st, rel FROM g)"
SEEDS = "s AS (SELECT CAST(s_suppkey AS BIGINT) AS query_id, upper(s_name) AS name, s_suppkey AS pos FROM supplier WHERE s_suppkey % 50 = 0 UNION ALL SELECT 0, lower(r_name), r_regionkey FROM region)"
PATHS = f"""{ENTITIES}, {EDGES}, {BOTH}, {SEEDS}, l AS (SELECT * FROM e WHERE status = 'active'),
st AS (SELECT s.query_id, l.name, l.type FROM s JOIN l ON lower(l.name) = lower(s.name)),
o AS (SELECT st.query_id, st.name AS seed, st.type AS stype, b.z, b.zt, 1.0 AS w, b.rel AS rels FROM st JOIN b ON b.a = st.name AND b.at = st.type
 UNION ALL SELECT st.query_id, st.name, st.type, c.z, c.zt, 0.5, b.rel || ',' || c.rel FROM st JOIN b ON b.a = st.name AND b.at = st.type JOIN b c ON c.a = b.z AND c.at = b.zt AND NOT (c.z = b.a AND c.zt = b.at AND c.rel = b.rel)),
k AS (SELECT o.*, row_number() OVER (PARTITION BY query_id, seed, z ORDER BY w DESC, rels) AS r FROM o JOIN l ON l.name = o.z AND l.type = o.zt WHERE z <> seed OR zt <> stype),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, seed, z) AS p FROM k WHERE r = 1)"""


@query(f"WITH {ENTITIES}, {EDGES} SELECT src, dst, rel, coalesce(confidence, 1.0) AS weight FROM g WHERE EXISTS (SELECT 1 FROM e WHERE status = 'active' AND name = src AND type = st) AND EXISTS (SELECT 1 FROM e WHERE status = 'active' AND name = dst AND type = dt)")
def graph_edges_active(t):
    return graph.active_edges(_entities(t), _edges(t)).select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), F.col("rel_type").alias("rel"), "weight")


@query(f"WITH {ENTITIES}, {EDGES}, {BOTH} SELECT e.name, e.type, count(b.rel) AS degree FROM e LEFT JOIN b ON b.a = e.name AND b.at = e.type GROUP BY e.name, e.type")
def graph_degrees(t):
    return graph.degrees(_entities(t), _edges(t))


@query(f"""WITH {EDGES}, {BOTH}, d AS (SELECT a AS name, count(*) AS degree FROM b GROUP BY a), s AS (SELECT 1 AS query_id, n_name AS name, n_nationkey AS pos FROM nation UNION ALL SELECT 2, r_name, r_regionkey FROM region),
x AS (SELECT s.*, coalesce(degree, 0) AS degree FROM s LEFT JOIN d ON d.name = s.name), y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY degree, pos) AS r, bool_or(degree <= 15) OVER (PARTITION BY query_id) AS few FROM x)
SELECT query_id, name FROM y WHERE (few AND degree <= 15) OR (NOT few AND r = 1)""")
def degree_hub_filter(t):
    seeds = t("nation").select(F.lit(1).alias("query_id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("pos")).unionByName(t("region").select(F.lit(2).alias("query_id"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("pos")))
    return graph.choose_seeds(seeds, _entities(t), _edges(t)).select("query_id", "name")


@query(f"WITH {PATHS} SELECT query_id, seed, z AS name, CAST(w AS DOUBLE) AS hop_weight, rels FROM h")
def traverse_2hop(t):
    found = graph.traverse(_seeds(t), _entities(t), _edges(t), EngineConfig(max_paths=10**9))
    return found.select("query_id", F.col("seed_name").alias("seed"), "name", "hop_weight", F.array_join("rel_types", ",").alias("rels"))


@query(f"WITH {PATHS} SELECT query_id, seed, z AS name, CAST(w AS DOUBLE) AS hop_weight FROM h WHERE p <= 30")
def path_cap(t):
    return graph.traverse(_seeds(t), _entities(t), _edges(t)).select("query_id", F.col("seed_name").alias("seed"), "name", "hop_weight")


@query(f"""WITH {PATHS}, q AS (SELECT h.query_id, unnest(e.docs) AS doc, e.idx, h.w FROM h JOIN e ON e.name = h.z AND e.type = h.zt WHERE p <= 30 AND e.idx IS NOT NULL
 UNION ALL SELECT s.query_id, l.docs[1], l.idx, NULL FROM s JOIN l ON lower(l.name) = lower(s.name) WHERE l.idx IS NOT NULL),
w AS (SELECT query_id, doc, idx, coalesce(max(w), 0.5) AS score FROM q GROUP BY query_id, doc, idx), c AS (SELECT CAST(doc_id % 100 AS VARCHAR) AS doc, CAST(doc_id // 100 AS BIGINT) AS idx, doc_id AS chunk_id FROM documents),
r AS (SELECT w.query_id, c.chunk_id, w.score, row_number() OVER (PARTITION BY w.query_id ORDER BY score DESC, w.doc, w.idx) AS r FROM w JOIN c ON c.doc = w.doc AND c.idx = w.idx)
SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score FROM r WHERE r <= 10""")
def resolve_chunks_weight(t):
    chunks = t("documents").select((F.col("doc_id") % 100).cast("string").alias("document_id"), F.expr("cast(doc_id div 100 as int)").alias("chunk_index"), F.col("doc_id").alias("chunk_id"))
    entities, seeds = _entities(t), _seeds(t)
    paths = graph.traverse(seeds, entities, _edges(t))
    return graph.resolve_chunks(paths, seeds, entities, chunks).select("query_id", "chunk_id", "score")


@query(f"WITH {ENTITIES}, w AS (SELECT r_name AS wanted FROM region), x AS (SELECT lower(n_name) AS wanted FROM nation UNION ALL SELECT lower(substr(n_name, 1, 2)) FROM nation), y AS (SELECT DISTINCT wanted FROM (SELECT * FROM w UNION ALL SELECT * FROM x)), z AS (SELECT wanted, name, type, row_number() OVER (PARTITION BY wanted ORDER BY name, type) AS r FROM y JOIN e ON status = 'active' AND contains(lower(name), lower(wanted))) SELECT wanted, name, type FROM z WHERE r <= 3")
def fuzzy_name_contains(t):
    """Regions' names, and nations' in lower case, whole and by their first two letters, which many names hold."""
    nation = t("nation").select(F.explode(F.array(F.lower("n_name"), F.lower(F.substring("n_name", 1, 2)))).alias("name"))
    names = t("region").select(F.col("r_name").alias("name")).unionByName(nation).distinct().withColumn("query_id", F.lit(1))
    return graph.match_names(names, _entities(t)).select("wanted", "name", "type")


NEAR = f"""i AS (SELECT c_name AS name, embedding FROM embeddings JOIN customer ON c_custkey = vec_id + 1 WHERE c_custkey % 11 <> 0 UNION ALL SELECT s_name, embedding FROM embeddings JOIN supplier ON s_suppkey = vec_id + 1),
ne AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS pos FROM (SELECT q.vec_id AS query_id, i.name, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])) AS score FROM embeddings q JOIN i ON true WHERE q.vec_id % 50 = 0) WHERE score > 0.75 QUALIFY pos <= 5),
wa AS (SELECT vec_id AS query_id, lower(substr(n_name, 1, 4)) AS wanted FROM embeddings JOIN nation ON n_nationkey = vec_id % 25 WHERE vec_id % 50 = 0 UNION SELECT vec_id, 'supplier#00000000' || (vec_id // 50 % 9 + 1) FROM embeddings WHERE vec_id % 50 = 0),
po AS (SELECT wa.*, (SELECT count(*) FROM ne WHERE ne.query_id = wa.query_id) AS have FROM wa),
ma AS (SELECT query_id, wanted, have, name, type FROM po JOIN e ON contains(lower(e.name), wanted) AND status = 'active' WHERE have < 2 QUALIFY row_number() OVER (PARTITION BY query_id, wanted ORDER BY name, type) <= 3),
se AS (SELECT query_id, name, pos FROM ne UNION ALL SELECT * FROM (SELECT query_id, name, have + row_number() OVER (PARTITION BY query_id ORDER BY wanted, name, type) AS pos FROM ma) m WHERE NOT EXISTS (SELECT 1 FROM ne WHERE ne.query_id = m.query_id AND ne.name = m.name)),
sf AS (SELECT * FROM se QUALIFY row_number() OVER (PARTITION BY query_id, lower(name) ORDER BY pos) = 1),
sd AS (SELECT sf.*, coalesce((SELECT max(n) FROM (SELECT b.a, b.at, count(*) AS n FROM b GROUP BY ALL) d JOIN e ON e.name = d.a AND e.type = d.at AND e.status = 'active' WHERE d.a = sf.name), 0) AS degree FROM sf),
sh AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY degree, pos) AS turn, bool_or(degree <= 15) OVER (PARTITION BY query_id) AS few FROM sd),
s AS (SELECT query_id, name, pos FROM sh WHERE (few AND degree <= 15) OR (NOT few AND turn = 1))"""


@query(f"""WITH {PATHS.replace(SEEDS, NEAR)}, q AS (SELECT h.query_id, unnest(e.docs) AS doc, e.idx, h.w FROM h JOIN e ON e.name = h.z AND e.type = h.zt WHERE p <= 30 AND e.idx IS NOT NULL
 UNION ALL SELECT s.query_id, l.docs[1], l.idx, NULL FROM s JOIN l ON lower(l.name) = lower(s.name) WHERE l.idx IS NOT NULL AND s.query_id IN (SELECT h.query_id FROM h JOIN e ON e.name = h.z AND e.type = h.zt WHERE p <= 30 AND e.idx IS NOT NULL)),
w AS (SELECT query_id, doc, idx, coalesce(max(w), 0.5) AS score FROM q GROUP BY query_id, doc, idx), c AS (SELECT CAST(doc_id % 100 AS VARCHAR) AS doc, CAST(doc_id // 100 AS BIGINT) AS idx, doc_id AS chunk_id FROM documents),
r AS (SELECT w.query_id, c.chunk_id, w.score, row_number() OVER (PARTITION BY w.query_id ORDER BY score DESC, w.doc, w.idx) AS r FROM w JOIN c ON c.doc = w.doc AND c.idx = w.idx)
SELECT x.query_id, x.seeds, coalesce(y.paths, 0) AS paths, r.chunk_id, CAST(r.score AS DOUBLE) AS score FROM (SELECT query_id, count(*) AS seeds FROM s GROUP BY query_id) x
 LEFT JOIN (SELECT query_id, count(*) AS paths FROM h WHERE p <= 30 GROUP BY query_id) y ON y.query_id = x.query_id LEFT JOIN r ON r.query_id = x.query_id AND r.r <= 10""")
def graph_search(t):
    """Every vector whose id is divisible by 50 asks for entities of near vectors, or by parts of names, and for their chunks over the graph."""
    entities, vecs = _entities(t), t("embeddings")
    asked = vecs.filter("vec_id % 50 = 0")
    live = entities.filter("status = 'active'").select("name")
    own = t("customer").select(F.col("c_name").alias("name"), (F.col("c_custkey") - 1).alias("vec_id")).unionByName(t("supplier").select(F.col("s_name").alias("name"), (F.col("s_suppkey") - 1).alias("vec_id")))
    index = vecs.join(own.join(live, "name", "left_semi"), "vec_id").select("name", "embedding")
    near = retrieval.nearest(index, asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), 5, "name", above=0.75)
    places = asked.join(t("nation"), F.col("n_nationkey") == F.col("vec_id") % 25).select(F.col("vec_id").alias("query_id"), F.lower(F.substring("n_name", 1, 4)).alias("name"))
    firms = asked.select(F.col("vec_id").alias("query_id"), F.concat(F.lit("supplier#00000000"), F.expr("vec_id div 50 % 9 + 1").cast("string")).alias("name"))
    chunks = t("documents").select((F.col("doc_id") % 100).cast("string").alias("document_id"), F.expr("cast(doc_id div 100 as int)").alias("chunk_index"), F.col("doc_id").alias("chunk_id"))
    seeds, paths, found = graph.search(near, places.unionByName(firms), entities, _edges(t), chunks)
    counts = seeds.groupBy("query_id").agg(F.count(F.lit(1)).alias("seeds")).join(paths.groupBy("query_id").agg(F.count(F.lit(1)).alias("paths")), "query_id", "left")
    return counts.select("query_id", "seeds", F.coalesce("paths", F.lit(0)).alias("paths")).join(found.select("query_id", "chunk_id", "score"), "query_id", "left")


def _mentions(t):
    """Names of orders' priorities and clerks as repeated mentions with varying spelling."""
    return t("orders").select(
        F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 3 == 0, F.lower("o_orderpriority")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.col("o_orderpriority"), F.lit("."))).otherwise(F.col("o_orderpriority")).alias("name"),
        F.col("o_orderstatus").alias("type"), (F.col("o_orderkey") % 1000 / 1000).alias("confidence"), F.create_map(F.concat(F.lit("k"), (F.col("o_orderkey") % 2).cast("string")), F.col("o_custkey").cast("string")).alias("properties"))


MENTIONS = "m AS (SELECT o_orderkey AS seq, CASE o_orderkey % 3 WHEN 0 THEN lower(o_orderpriority) WHEN 1 THEN o_orderpriority || '.' ELSE o_orderpriority END AS name, o_orderstatus AS type, o_orderkey % 1000 / 1000.0 AS confidence, 'k' || (o_orderkey % 2) AS pk, CAST(o_custkey AS VARCHAR) AS pv FROM orders), d AS (SELECT *, regexp_replace(lower(trim(name)), '[.,;:!?]+$', '') AS norm FROM m)"


@query(f"WITH {MENTIONS} SELECT norm, type, arg_max(name, (confidence, -seq)) AS name, CAST(max(confidence) AS DOUBLE) AS confidence, arg_max(pv, seq) FILTER (WHERE pk = 'k0') AS k0, arg_max(pv, seq) FILTER (WHERE pk = 'k1') AS k1 FROM d GROUP BY norm, type")
def entity_exact_dedup(t):
    own = graph.dedup_entities(_mentions(t))
    return own.select(F.col("norm_name").alias("norm"), "type", "name", "confidence", F.try_element_at("properties", F.lit("k0")).alias("k0"), F.try_element_at("properties", F.lit("k1")).alias("k1"))


@query(f"WITH {MENTIONS}, r AS (SELECT norm, seq % 5 AS target, type, seq, confidence, row_number() OVER (PARTITION BY norm, seq % 5, type ORDER BY confidence DESC, seq) AS r FROM d) SELECT norm AS source, CAST(target AS VARCHAR) AS target, type, seq, CAST(confidence AS DOUBLE) AS confidence FROM r WHERE r = 1")
def rel_dedup(t):
    own = _mentions(t).select("seq", F.col("name").alias("source_entity"), (F.col("seq") % 5).cast("string").alias("target_entity"), "type", "confidence")
    from quillgraph.functions.text import normalize_name

    return graph.dedup_relationships(own).select(normalize_name("source_entity").alias("source"), F.col("target_entity").alias("target"), "type", "seq", "confidence")


@query("""WITH x AS (SELECT c_name AS name, c_mktsegment AS type, c_acctbal AS conf, c_custkey AS k FROM customer), o AS (SELECT * FROM x WHERE k % 3 <> 0), n AS (SELECT * FROM x WHERE k % 2 = 0)
SELECT coalesce(o.name, n.name) AS name, CASE WHEN o.name IS NULL THEN 'new' WHEN n.name IS NULL THEN 'old' ELSE 'old,new' END AS docs, greatest(o.conf, n.conf - 1) AS confidence, CASE WHEN n.name IS NULL THEN 'deprecated' ELSE 'active' END AS status FROM o FULL JOIN n ON o.name = n.name AND o.type = n.type""")
def entity_merge_upsert(t):
    none = F.lit(None).cast("map<string,string>")
    x = t("customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.col("c_acctbal").alias("confidence"), F.lit(0).alias("source_chunk_index"), none.alias("properties"))
    old = x.filter("c_custkey % 3 <> 0").withColumn("source_document_ids", F.array(F.lit("old"))).withColumn("status", F.lit("deprecated")).withColumn("community_id", F.lit(None).cast("int"))
    new = x.filter("c_custkey % 2 = 0").withColumn("source_document_id", F.lit("new")).withColumn("confidence", F.col("confidence") - 1)
    return graph.merge_entities(old, new).select("name", F.array_join("source_document_ids", ",").alias("docs"), "confidence", "status")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 AND c_custkey % 4 IN (1, 2) THEN 'deprecated' ELSE 'active' END AS status FROM customer""")
def deprecate_changed_chunks(t):
    own = t("customer").select("c_custkey", F.array((F.col("c_custkey") % 10).cast("string")).alias("source_document_ids"), (F.col("c_custkey") % 4).cast("int").alias("source_chunk_index"), F.lit("active").alias("status"))
    return graph.deprecate_document(own, "3", [1, 2]).select("c_custkey", "status")


@query(f"WITH {EDGES}, x AS (SELECT n_name AS name, 'Nation' AS type, n_regionkey AS c FROM nation UNION ALL SELECT r_name, 'Region', r_regionkey FROM region), i AS (SELECT c, count(*) AS size, string_agg(DISTINCT type, ',' ORDER BY type) AS types, string_agg(name, ',' ORDER BY name) AS names FROM x GROUP BY c), y AS (SELECT c, rel FROM g JOIN x ON x.name = src AND x.type = st UNION ALL SELECT c, rel FROM g JOIN x ON x.name = dst AND x.type = dt), z AS (SELECT c, string_agg(DISTINCT rel, ',' ORDER BY rel) AS rels FROM y GROUP BY c) SELECT CAST(i.c AS BIGINT) AS community, size, names, types, coalesce(rels, '') AS rels FROM i LEFT JOIN z ON i.c = z.c")
def community_info(t):
    own = t("nation").select(F.col("n_name").alias("name"), F.lit("Nation").alias("type"), F.col("n_regionkey").alias("community_id")).unionByName(t("region").select(F.col("r_name").alias("name"), F.lit("Region").alias("type"), F.col("r_regionkey").alias("community_id")))
    info = graph.community_info(own, _edges(t))
    return info.select(F.col("community_id").cast("long").alias("community"), "size", F.array_join("entity_names", ",").alias("names"), F.array_join("entity_types", ",").alias("types"), F.array_join("relationship_types", ",").alias("rels"))


@query(f"WITH {EDGES} SELECT DISTINCT src || '::' || st AS h, rel AS r, dst || '::' || dt AS t FROM g WHERE src || st <> dst || dt")
def transe_triples(t):
    return graph.triples(_edges(t))


@query(f"""WITH {EDGES}, n AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), x AS (SELECT src || '::' || st AS node, r_name FROM g JOIN n ON n.n_name = CASE WHEN st = 'Nation' THEN src ELSE dst END UNION SELECT r_name || '::Region', r_name FROM n)
SELECT node, min(node) OVER (PARTITION BY r_name) AS component FROM x""")
def community_components(t):
    """Components of the whole graph: what hangs together through nations and regions."""
    return community.components(community.undirected(_edges(t).withColumn("weight", F.lit(1.0))))


def _active(t):
    """All edges between active entities."""
    return graph.active_edges(_entities(t), _edges(t))


@query()
def leiden(t):
    return community.detect(community.undirected(_active(t)))


@query()
def entity_fuzzy_dedup(t):
    own = t("part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"), (F.col("p_size") / 50).alias("confidence"), F.create_map(F.lit("brand"), F.col("p_brand")).alias("properties"))
    return entity_dedup.dedup_enhanced(own).select("type", "norm_name", "name", F.array_join("names", ",").alias("names"))


@query()
def entity_embed_dedup(t):
    own = t("embeddings").select(F.col("vec_id").alias("seq"), F.concat(F.lit("entity "), F.col("vec_id").cast("string")).alias("name"), F.col("label").cast("string").alias("type"), F.lit(1.0).alias("confidence"), F.create_map(F.lit("id"), F.col("vec_id").cast("string")).alias("properties"))
    exact = graph.dedup_entities(own).withColumn("names", F.array("name")).join(t("embeddings").select(F.col("vec_id").alias("first_seq"), F.col("embedding").alias("vector")), "first_seq")
    return entity_dedup.vector_tier(exact).select("type", "name", F.size("names").cast("long").alias("merged"))


@query()
def sage_embeddings(t):
    edges = community.undirected(_active(t))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    from quillgraph.plans.providers import hashed_embedding

    config = EngineConfig(train_epochs=20, sage_dims=(32, 16, 16))
    found, _ = graph_learning.sage(nodes.withColumn("x", hashed_embedding("node", 32)), edges, config)
    return found.select("node", F.size("embedding").cast("long").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 6).alias("length"))


@query()
def transe_embeddings(t):
    entities, relations = graph_learning.transe(graph.triples(_active(t)), 16, EngineConfig(train_epochs=30))
    both = entities.select(F.col("node").alias("name"), "embedding").unionByName(relations.select(F.col("relation_type").alias("name"), "embedding"))
    return both.select("name", F.size("embedding").cast("long").alias("dim"))

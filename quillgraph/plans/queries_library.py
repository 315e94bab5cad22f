"""Queries that run the library's own steps on whole tables: graph writes, ingestion parts, vectors, answering and the catalog."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.config import EngineConfig
from quillgraph.functions import text, vectors
from quillgraph.operators import assembly, community, graph, graph_learning, listings, retrieval
from quillgraph.plans import batch, ingest
from quillgraph.plans.answering import Engine
from quillgraph.plans.providers import Providers
from quillgraph.plans.queries_graph import EDGES, ENTITIES, MENTIONS, _edges, _entities, _mentions
from quillgraph.plans.queries_search import CLOCK, _whole, now
from quillgraph.plans.registry import query
from quillgraph.plans.service import Service
from quillgraph.sources import files, office_files
from quillgraph.sources.catalog import Catalog, no_automatic_broadcast, settled
from quillgraph.streaming import logs
from quillgraph.streaming.versions import VERSION, version_stream


def _catalog(df: DataFrame) -> Catalog:
    """An empty catalog in the folder that driver and executors share."""
    spark: SparkSession = df.sparkSession
    root = settled(spark.range(1)).inputFiles()[0].rsplit("/", 2)[0]
    return Catalog(spark, f"{root}/catalog-{uuid.uuid4().hex}")


# Graph writes and reads

@query("""WITH o AS (SELECT s_name AS src, n_name AS dst, 'Nation' AS dt, s_acctbal AS confidence FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 <> 0),
ends AS (SELECT n_name AS dst, 'Nation' AS dt FROM nation UNION ALL SELECT n_name, 'Place' FROM nation WHERE n_regionkey = 1),
n AS (SELECT s_name AS src, ends.dst, dt, s_acctbal - 1 AS confidence FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN ends ON ends.dst = n_name WHERE s_suppkey % 2 = 0)
SELECT coalesce(n.src, o.src) AS src, coalesce(n.dst, o.dst) AS dst, coalesce(n.dt, o.dt) AS dst_type, greatest(o.confidence, n.confidence) AS confidence, CASE WHEN n.src IS NULL THEN 'old' ELSE 'new' END AS doc
FROM o FULL JOIN n ON o.src = n.src AND o.dst = n.dst AND o.dt = n.dt""")
def rel_merge_upsert(t):
    """Edges are merged by their ends and type; ends are found by name in every type, and edges without ends are dropped."""
    own = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    none = F.lit(None).cast("map<string,string>")
    old = own.filter("s_suppkey % 3 <> 0").select(F.col("s_name").alias("src_name"), F.lit("Supplier").alias("src_type"), F.col("n_name").alias("dst_name"), F.lit("Nation").alias("dst_type"), F.lit("IN").alias("rel_type"), F.lit("old").alias("source_document_id"), F.lit(0).alias("source_chunk_index"), F.col("s_acctbal").alias("confidence"), none.alias("properties"))
    old = old.withColumn("edge_id", graph.edge_id("src_name", "src_type", "rel_type", "dst_name", "dst_type"))
    new = own.filter("s_suppkey % 2 = 0").select(F.col("s_name").alias("source_entity"), F.explode(F.array("n_name", F.lit("nowhere"))).alias("target_entity"), F.lit("IN").alias("type"), F.lit("new").alias("source_document_id"), F.lit(1).alias("source_chunk_index"), (F.col("s_acctbal") - 1).alias("confidence"), none.alias("properties"))
    places = t("nation").filter("n_regionkey = 1").select(F.col("n_name").alias("name"), F.lit("Place").alias("type"))
    ends = t("supplier").select(F.col("s_name").alias("name"), F.lit("Supplier").alias("type")).unionByName(t("nation").select(F.col("n_name").alias("name"), F.lit("Nation").alias("type"))).unionByName(places)
    return graph.merge_relationships(old, new, ends).select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), "dst_type", "confidence", F.col("source_document_id").alias("doc"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 OR c_custkey % 7 = 3 THEN 'deprecated' ELSE 'active' END AS status FROM customer")
def deprecate_whole_document(t):
    docs = F.array(*[(F.col("c_custkey") % n).cast("string") for n in (10, 7)])
    own = t("customer").select("c_custkey", docs.alias("source_document_ids"), F.lit(None).cast("int").alias("source_chunk_index"), F.lit("active").alias("status"))
    return graph.deprecate_document(own, "3").select("c_custkey", "status")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'kept' WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS docs, CASE WHEN c_custkey % 2 = 0 THEN 'deprecated' ELSE 'active' END AS status FROM customer""")
def migrate_old_entities(t):
    own = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("kept"))).alias("source_document_ids"), F.when(F.col("c_custkey") % 3 < 2, F.col("c_mktsegment")).alias("source_document_id"), F.when(F.col("c_custkey") % 2 == 0, "deprecated").alias("status"))
    return graph.migrate_entities(own).select("c_custkey", F.array_join("source_document_ids", ",").alias("docs"), "status")


@query(f"""WITH {MENTIONS}, n AS (SELECT norm, min(name) AS name FROM (SELECT norm, arg_max(name, (confidence, -seq)) AS name, type FROM d GROUP BY norm, type QUALIFY row_number() OVER (PARTITION BY norm ORDER BY type) = 1) GROUP BY norm),
r AS (SELECT norm, seq % 5 AS target, type, seq, row_number() OVER (PARTITION BY norm, seq % 5, type ORDER BY confidence DESC, seq) AS r FROM d) SELECT n.name AS source, CAST(target AS VARCHAR) AS target, type, seq FROM r JOIN n ON n.norm = r.norm WHERE r = 1""")
def rel_dedup_canonical(t):
    """Endpoints take the spelling that the entity of their normalised name has, of the least type where several have it."""
    own = _mentions(t).select("seq", F.col("name").alias("source_entity"), (F.col("seq") % 5).cast("string").alias("target_entity"), "type", "confidence")
    return graph.dedup_relationships(own, graph.dedup_entities(_mentions(t))).select(F.col("source_entity").alias("source"), F.col("target_entity").alias("target"), "type", "seq")


@query(f"WITH {EDGES} SELECT least(src || '::' || st, dst || '::' || dt) AS a, greatest(src || '::' || st, dst || '::' || dt) AS b, CAST(coalesce(confidence, 1.0) AS DOUBLE) AS weight FROM g WHERE src <> dst OR st <> dt")
def undirected_edges(t):
    return community.undirected(_edges(t).withColumn("weight", F.coalesce("confidence", F.lit(1.0))))


@query(f"""WITH {EDGES}, u AS (SELECT src || '::' || st AS a, dst || '::' || dt AS b FROM g), w AS (SELECT a, b FROM u UNION ALL SELECT b, a FROM u) SELECT a AS node, count(*) AS n, min(b) AS least, max(b) AS most FROM w WHERE a <> b GROUP BY a""")
def graph_adjacency(t):
    own = graph_learning.adjacency(community.undirected(_edges(t).withColumn("weight", F.lit(1.0))))
    return own.select("node", F.size("neighbours").cast("long").alias("n"), F.array_min("neighbours").alias("least"), F.array_max("neighbours").alias("most"))


@query(f"WITH {ENTITIES}, x AS (SELECT name, type, unnest(docs) AS doc FROM e WHERE status = 'active') SELECT doc, count(*) AS entities, min(name) AS first_name FROM x GROUP BY doc")
def document_entities(t):
    """The active entities of each document."""
    own = _entities(t).filter("status = 'active'").select("name", "type", F.explode("source_document_ids").alias("doc"))
    return own.groupBy("doc").agg(F.count(F.lit(1)).alias("entities"), F.min("name").alias("first_name"))


@query("""WITH x AS (SELECT n_regionkey AS k, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey)
SELECT CAST(k AS BIGINT) AS k, CASE WHEN k = 2 THEN '' ELSE 'Entities: ' || names || chr(10) || 'Entity types: Nation, Place' || chr(10) || CASE WHEN k <> 3 THEN 'Relationships: PART_OF' || chr(10) ELSE '' END || 'Summary: ' || r_name END AS body FROM x JOIN region ON k = r_regionkey""")
def community_texts(t):
    names = t("nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    own = names.join(t("region"), F.col("k") == F.col("r_regionkey"))
    kinds = F.when(F.col("k") != 3, F.array(F.lit("PART_OF"))).otherwise(F.array().cast("array<string>"))
    summary = F.when(F.col("k") != 2, F.col("r_name"))
    return own.select(F.col("k").cast("long").alias("k"), text.community_embedding_text("names", F.array(F.lit("Nation"), F.lit("Place")), kinds, summary).alias("body"))


# Vectors

@query("""WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT vec_id, unnest(range(1, 9)) AS i, v FROM x),
m AS (SELECT vec_id, i, CASE vec_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN v[i] ELSE (v[i] + v[i + 8] + v[i + 16]) / 3 END AS y FROM p)
SELECT vec_id, count(*) AS dim, round(sum(y), 6) AS total, round(sum(y * i), 6) AS mark FROM m GROUP BY vec_id""")
def vec_mean_pool(t):
    """The mean of none, one or three vectors."""
    v = vectors.as_doubles("embedding")
    none = F.array().cast("array<array<double>>")
    parts = F.when(F.col("vec_id") % 4 == 0, none).when(F.col("vec_id") % 4 == 1, F.array(F.slice(v, 1, 8))).otherwise(F.array(*[F.slice(v, k, 8) for k in (1, 9, 17)]))
    own = t("embeddings").select("vec_id", vectors.mean_pool(parts, 8).alias("m"))
    marked = F.aggregate(F.transform("m", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return own.select("vec_id", F.size("m").cast("long").alias("dim"), F.round(F.aggregate("m", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(marked, 6).alias("mark"))


@query("""WITH x AS (SELECT vec_id, CAST(embedding[1:32] AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda a: a * a))) AS size FROM x)
SELECT vec_id, 48 AS dim, round(v[1] / size, 6) AS head, round(list_sum(v) / size, 6) AS total, 0.0 AS tail FROM n""")
def vec_query_hybrid(t):
    own = t("embeddings").select("vec_id", vectors.query_hybrid("embedding", 32, 8).alias("h"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return own.select("vec_id", F.size("h").cast("int").alias("dim"), F.round(F.col("h")[0], 6).alias("head"), F.round(total("h"), 6).alias("total"), F.round(total(F.slice("h", 33, 16)), 6).alias("tail"))


@query("""WITH x AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN NULL ELSE CAST(embedding AS DOUBLE[]) END AS v FROM embeddings)
SELECT a.vec_id, round(coalesce(list_cosine_similarity(a.v, b.v), 0.0), 6) AS score FROM x a JOIN x b ON b.vec_id = a.vec_id + 1""")
def vec_cosine_of_next(t):
    """Cosine of each vector and the next; 0 where one has no length."""
    own = t("embeddings").select("vec_id", F.when(F.col("vec_id") % 10 == 0, F.transform(vectors.as_doubles("embedding"), lambda x: F.lit(0.0))).otherwise(vectors.as_doubles("embedding")).alias("v"))
    after = own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return own.join(after, "vec_id").select("vec_id", F.round(vectors.cosine("v", "w"), 6).alias("score"))


@query("""WITH x AS (SELECT vec_id, vec_id % 50 AS d, vec_id // 50 AS c, CAST(embedding AS FLOAT[]) AS v FROM embeddings),
e AS (SELECT d, c, v[1:8] AS s, v[9:16] AS r FROM x WHERE vec_id % 3 <> 0 UNION ALL SELECT d, c, v[17:24], v[25:32] FROM x WHERE vec_id % 4 = 0),
i AS (SELECT unnest(range(1, 9)) AS i), m AS (SELECT d, c, i, avg(CAST(s[i] AS DOUBLE)) AS s, avg(CAST(r[i] AS DOUBLE)) AS r FROM e, i GROUP BY d, c, i),
l AS (SELECT d, c, sqrt(sum(s * s)) AS ns, sqrt(sum(r * r)) AS nr, max(s) FILTER (WHERE i = 1) AS s1, max(r) FILTER (WHERE i = 1) AS r1 FROM m GROUP BY d, c),
y AS (SELECT x.*, l.*, CAST(v[1] AS DOUBLE) / sqrt(list_sum(list_transform(CAST(v[1:32] AS DOUBLE[]), lambda a: a * a))) AS t1, sqrt(CASE WHEN l.d IS NULL THEN 1.0 ELSE 3.0 END) AS n FROM x LEFT JOIN l ON l.d = x.d AND l.c = x.c)
SELECT vec_id, round(t1 / n, 4) AS words, round(coalesce(s1 / ns / n, 0.0), 4) AS structural, round(coalesce(r1 / nr / n, 0.0), 4) AS translational FROM y""")
def hybrid_vectors_of_chunks(t):
    """Chunk vectors with the means of the vectors of the entities in them, through the catalog's tables."""
    x = t("embeddings")
    catalog = _catalog(x)
    at = [(F.col("vec_id") % 50).cast("string"), F.expr("cast(vec_id div 50 as int)")]
    catalog.write("chunks", x.select(F.col("vec_id").cast("string").alias("id"), at[0].alias("document_id"), at[1].alias("chunk_index")))
    catalog.write("chunk_embeddings", x.select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding"))
    v = F.col("embedding")
    own = [x.filter(f"vec_id % {n} {test}").select(F.col("vec_id").cast("string").alias("name"), F.lit(kind).alias("type"), F.array(at[0]).alias("source_document_ids"), at[1].alias("source_chunk_index"), F.lit("active").alias("status"), F.slice(v, k, 8).alias("structural"), F.slice(v, k + 8, 8).alias("transe")) for n, test, kind, k in ((3, "<> 0", "A", 1), (4, "= 0", "B", 17))]
    entities = own[0].unionByName(own[1])
    catalog.write("entities", entities)
    catalog.write("entity_embeddings", entities)
    ingest.Ingestion(catalog, config=EngineConfig(text_dim=32, part_dim=8)).hybrid_vectors()
    h = F.col("hybrid")
    return catalog.read("chunk_embeddings").select(F.col("chunk_id").cast("long").alias("vec_id"), *[F.round(h[k].cast("double"), 4).alias(n) for n, k in (("words", 0), ("structural", 32), ("translational", 40))])


@query(f"""WITH {ENTITIES}, {EDGES}, a AS (SELECT * FROM e WHERE status = 'active'), x AS (SELECT g.* FROM g JOIN a s ON s.name = src AND s.type = st JOIN a d ON d.name = dst AND d.type = dt)
SELECT 'entities placed' AS what, count(*) AS n FROM a UNION ALL SELECT 'entities in communities', count(*) FROM a UNION ALL SELECT 'entities without a community', count(*) FROM e WHERE status <> 'active'
UNION ALL SELECT 'edges across components', 0 UNION ALL SELECT 'entity vectors', count(*) FROM a UNION ALL SELECT 'translated', count(DISTINCT n) FROM (SELECT src || '::' || st AS n FROM x UNION ALL SELECT dst || '::' || dt FROM x)
UNION ALL SELECT 'relation vectors', count(DISTINCT rel) FROM x UNION ALL SELECT 'community vectors', 1""")
def after_batch(t):
    """Communities, their texts and vectors, and graph vectors of the whole graph, as a batch of files leaves them in the catalog."""
    entities = _entities(t)
    catalog = _catalog(entities)
    catalog.write("entities", entities.withColumn("confidence", F.lit(1.0)))
    catalog.write("relationships", _edges(t))
    config = EngineConfig(text_dim=32, part_dim=8, train_epochs=3, sage_dims=(16, 8, 8))
    told = ingest.Ingestion(catalog, config=config, clock=now()).after_batch()
    if set(told.values()) != {"done"}:
        raise RuntimeError(str(told))
    with no_automatic_broadcast(catalog.spark):
        placed, made, vecs = catalog.read("entities"), catalog.read("communities"), catalog.read("entity_embeddings")
        edges = graph.active_edges(placed, catalog.read("relationships"))
        parts = community.components(community.undirected(edges))
        of = placed.withColumn("node", F.concat_ws("::", "name", "type")).join(parts, "node")
        across = of.groupBy("community_id").agg(F.countDistinct("component").alias("n")).filter("n > 1")
        large = made.filter(F.col("entity_count") >= config.community_min_size).count()
        n = lambda what, df, column=F.lit(1): df.agg(F.count(column).alias("n")).select(F.lit(what).alias("what"), "n")
        out = n("entities placed", placed, F.col("community_id"))
        out = out.unionByName(made.agg(F.sum("entity_count").alias("n")).select(F.lit("entities in communities").alias("what"), "n"))
        out = out.unionByName(n("entities without a community", placed.filter("community_id is null")))
        out = out.unionByName(n("edges across components", across)).unionByName(n("entity vectors", vecs.filter("size(structural) = 8 and size(text) = 16"))).unionByName(n("translated", vecs.filter("size(transe) = 8")))
        out = out.unionByName(n("relation vectors", catalog.read("relation_embeddings")))
        found = catalog.read("community_embeddings").filter("size(embedding) = 32").agg(F.count(F.lit(1)).alias("n"))
        return settled(out.unionByName(found.select(F.lit("community vectors").alias("what"), (F.col("n") == F.lit(large)).cast("long").alias("n"))))


# Text

@query("""SELECT doc_id, sha256(text || ' ' || CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END || ' ' || CASE WHEN doc_id % 3 = 0 THEN 'a? b?' ELSE '' END || ' ' || CASE WHEN doc_id % 5 = 0 THEN lang || ' ' || source ELSE '' END) AS digest FROM documents""")
def search_text_build(t):
    own = text.search_text("text", F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a?"), F.lit("b?"))), F.when(F.col("doc_id") % 5 == 0, F.array("lang", "source")))
    return t("documents").select("doc_id", F.sha2(own.cast("binary"), 256).alias("digest"))


@query("""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts FROM documents),
u AS (SELECT doc_id, unnest(parts) AS sentence, unnest(range(len(parts))) AS i FROM s),
n AS (SELECT *, sum(len(regexp_extract_all(sentence, '\\p{L}+|\\p{N}+|[^\\s\\p{L}\\p{N}]'))) OVER (PARTITION BY doc_id ORDER BY i DESC) AS used FROM u)
SELECT doc_id, sha256(coalesce(string_agg(sentence, ' ' ORDER BY i) FILTER (WHERE used <= 40), '')) AS digest FROM n GROUP BY doc_id""")
def trailing_overlap_digest(t):
    return t("documents").select("doc_id", F.sha2(text.trailing_sentences("text", 40).cast("binary"), 256).alias("digest"))


@query("""WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn, sha256(CASE WHEN turn % 4 <> 3 AND coalesce(before, '') <> '' AND length(text) > 0 THEN split_part(before, ' ', 1) || substr(text, 2) ELSE text END) AS digest FROM c""")
def coref_of_chunks(t):
    """A mention at the start of each chunk of enough tokens is replaced by the first word of the chunk before."""
    resolve = lambda before, content: [(0, 1, before.split(" ")[0])] if before else []
    own = t("conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").cast("int").alias("chunk_index"), F.col("text").alias("content"), F.when(F.col("turn") % 4 == 3, 9).otherwise(10).alias("token_count"))
    done = ingest.coref(own, Providers(coref=resolve))
    return done.select(F.col("document_id").alias("conv_id"), F.col("chunk_index").cast("long").alias("turn"), F.sha2(F.col("content").cast("binary"), 256).alias("digest"))


@query("""WITH x AS (SELECT s_suppkey, replace(s_name, '#', ' ') || ' Corporation' AS c, n_name, CAST(s_suppkey % 7 AS VARCHAR) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, 0 AS turn, c || ' is located in ' || n_name || '.' AS content FROM x
UNION ALL SELECT s_suppkey, 1, c || ' owes ' || k || ' dollars. Today ' || c || ' sold ' || c || ' shares to Mrs. Jane Doe' || k || '. Mrs. Jane Doe' || k || ' thanked ' || c || '.' FROM x
UNION ALL SELECT s_suppkey, 2, 'Mrs. Jane Doe' || k || ' left. It rained.' FROM x""")
def coref_of_suppliers(t):
    """Pronouns, parts of names and definite nouns in three chunks about each supplier, replaced by the default rules."""
    own = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    firm, k = F.concat(F.replace("s_name", F.lit("#"), F.lit(" ")), F.lit(" Corporation")), (F.col("s_suppkey") % 7).cast("string")
    turns = [
        F.concat(firm, F.lit(" is located in "), "n_name", F.lit(".")),
        F.concat(F.lit("The corporation owes "), k, F.lit(" dollars. Today it sold its shares to Mrs. Jane Doe"), k, F.lit(". She thanked the company.")),
        F.lit("She left. It rained."),
    ]
    rows = own.select("s_suppkey", F.posexplode(F.array(*turns)).alias("turn", "content")).select(F.col("s_suppkey").cast("string").alias("document_id"), "s_suppkey", F.col("turn").alias("chunk_index"), "content", F.lit(20).alias("token_count"))
    return ingest.coref(rows, Providers()).select("s_suppkey", F.col("chunk_index").alias("turn"), "content")


@query()
def coref_of_conversations(t):
    """Every turn with the mentions that the turn before or its own text explains, replaced by the default rules."""
    rows = t("conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").cast("int").alias("chunk_index"), F.col("text").alias("content"), text.token_count("text").alias("token_count"))
    return ingest.coref(rows, Providers()).select(F.col("document_id").alias("conv_id"), F.col("chunk_index").cast("long").alias("turn"), "content")


@query(f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '' ELSE substr(text, 1, 20) END AS summary, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 0 ELSE 2 END AS keywords,
 round(greatest(0.0, 1 - (doc_id % 400) / 365.0), 4) AS freshness, CAST(2 AS INT) AS version FROM documents""")
def enrich_chunks(t):
    """Metadata of chunks: none from the model for small chunks, empty where it fails."""

    def told(content):
        if content.startswith("!"):
            raise ValueError("no reply")
        return {"summary": content[:20], "keywords": ["a", "b"], "hypothetical_questions": [], "entities": {}}

    own = t("documents")
    content = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("!"), "text")).otherwise(F.col("text"))
    chunks = own.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("document_id"), content.alias("content"), F.when(F.col("doc_id") % 3 == 0, 9).otherwise(10).alias("token_count"), F.lit(None).cast("string").alias("section_path"), F.lit(False).alias("has_table"), F.lit(False).alias("has_code"), F.lit("h").alias("content_hash"))
    docs = own.select(F.col("doc_id").cast("string").alias("id"), F.lit(2).alias("version"), (now() - F.make_dt_interval(F.col("doc_id") % 400)).alias("ingested_at"))
    m = ingest.enriched(chunks, docs, Providers(enrich=told), now()).select(F.col("id").cast("long").alias("doc_id"), "metadata.*")
    return m.select("doc_id", "summary", F.when(F.col("keywords").isNotNull(), F.size("keywords")).alias("keywords"), F.col("freshness_score").alias("freshness"), "version")


@query("""WITH c AS (SELECT conv_id, turn, split_part(text, ' ', 1) AS a, split_part(text, ' ', 2) AS b FROM conversations WHERE turn % 3 <> 0 AND turn % 5 <> 4)
SELECT conv_id, turn, 'entity' AS kind, a AS name, '' AS target, 'Unknown' AS type, 1.0::DOUBLE AS confidence FROM c UNION ALL SELECT conv_id, turn, 'entity', b, '', 'Word', 0.5 FROM c UNION ALL SELECT conv_id, turn, 'relationship', a, b, 'RELATED_TO', 1.0 FROM c""")
def extract_from_chunks(t):
    """Entities and relationships with their defaults; chunks that are small or fail add nothing."""

    def told(content):
        words = content.split(" ")
        if words[0] == "!":
            raise ValueError("no reply")
        first, second = words[0], words[1] if len(words) > 1 else ""
        return {"entities": [{"name": first}, {"name": second, "type": "Word", "confidence": 0.5}, {"type": "Nameless"}], "relationships": [{"source": first, "target": second}]}

    own = t("conversations").select(F.col("conv_id").cast("string").alias("document_id"), F.col("turn").cast("int").alias("chunk_index"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("! "), "text")).otherwise(F.col("text")).alias("content"), F.when(F.col("turn") % 5 == 4, 9).otherwise(10).alias("token_count"))
    entities, relations = ingest.extracted(own, Providers(extract=told))
    at = [F.col("source_document_id").cast("long").alias("conv_id"), F.col("source_chunk_index").cast("long").alias("turn")]
    found = entities.select(*at, F.lit("entity").alias("kind"), "name", F.lit("").alias("target"), "type", "confidence")
    return found.unionByName(relations.select(*at, F.lit("relationship").alias("kind"), F.col("source_entity").alias("name"), F.col("target_entity").alias("target"), "type", "confidence"))


@query("""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page, CASE WHEN conv_id % 3 = 2 THEN role || chr(10) || trim(regexp_replace(text, '\\s+', ' ', 'g')) ELSE '# ' || role || chr(10) || chr(10) || trim(text) END AS markdown FROM conversations""")
def office_pages(t):
    """Conversations written as DOCX, PPTX and PDF files, a page for each turn, and read back."""
    def write(rows):
        for own in (batch.slice(at, files.ROWS) for batch in rows for at in range(0, batch.num_rows, files.ROWS)):
            out = [office_files.WRITERS[k](p) for k, p in zip(own.column("kind").to_pylist(), own.column("pages").to_pylist())]
            yield pa.RecordBatch.from_arrays([own.column("path"), pa.array([len(x) for x in out], pa.int64()), pa.array(out, pa.binary())], names=["path", "length", "content"])

    kind = F.element_at(F.array(*map(F.lit, ("docx", "pptx", "pdf"))), (F.col("conv_id") % 3 + 1).cast("int"))
    own = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    own = own.select(F.concat_ws(".", "conv_id", kind).alias("path"), kind.alias("kind"), F.transform("turns", lambda x: F.array(x["role"], x["text"])).alias("pages"))
    made = own.mapInArrow(write, "path string, length bigint, content binary")
    read = files.parsed(files.validated(made), Providers().parse).filter("error is null")
    return read.select(F.substring_index("path", ".", 1).cast("long").alias("conv_id"), F.posexplode("pages").alias("page", "markdown")).select("conv_id", (F.col("page") + 1).cast("long").alias("page"), "markdown")


# Search

PLACES = "w AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents), p AS (SELECT chunk_id, unnest(ws) AS lexeme, unnest(range(1, len(ws) + 1)) AS place FROM w)"


#: Of every document that holds all words of an item: its covers, from the place of each word's last occurrence so far.
DENSITY = f"""{PLACES}, q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS lexeme FROM benchmark), k AS (SELECT query_id, count(*) AS wanted FROM q GROUP BY query_id),
m AS (SELECT q.query_id, p.chunk_id, any_value(wanted) AS wanted FROM (SELECT DISTINCT chunk_id, lexeme FROM p) p JOIN q ON q.lexeme = p.lexeme JOIN k ON k.query_id = q.query_id GROUP BY q.query_id, p.chunk_id HAVING count(*) = any_value(wanted)),
h AS (SELECT m.query_id, m.chunk_id, wanted, p.lexeme, place, row_number() OVER (PARTITION BY m.query_id, m.chunk_id ORDER BY place) AS here FROM m JOIN p ON p.chunk_id = m.chunk_id JOIN q ON q.query_id = m.query_id AND q.lexeme = p.lexeme),
l AS (SELECT a.query_id, a.chunk_id, a.wanted, a.here, a.place, b.lexeme, max(b.here) AS last FROM h a JOIN h b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id AND b.here <= a.here GROUP BY ALL),
b AS (SELECT query_id, chunk_id, here, place, min(last) AS start FROM l GROUP BY query_id, chunk_id, wanted, here, place HAVING count(*) = wanted),
c AS (SELECT *, coalesce(start > lag(start) OVER (PARTITION BY query_id, chunk_id ORDER BY here), true) AS new FROM b),
d AS (SELECT c.query_id, c.chunk_id, sum(0.1 / (1 + greatest(c.place - h.place - (c.here - c.start), 0))) AS r FROM c JOIN h ON h.query_id = c.query_id AND h.chunk_id = c.chunk_id AND h.here = c.start WHERE new GROUP BY c.query_id, c.chunk_id),
y AS (SELECT query_id, chunk_id, round(CAST(r / (r + 1) AS DOUBLE), 12) AS score FROM d)"""


def _items(t):
    return t("benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {DENSITY} SELECT query_id, chunk_id, round(score, 6) AS score FROM y")
def lex_cover_density_all(t):
    """Cover density of the whole text of every benchmark item in every document that holds all its words."""
    found = retrieval.match_texts(_whole(t), retrieval.query_lexemes(_items(t)))
    return found.select("query_id", "chunk_id", F.round(retrieval.density(), 6).alias("score"))


@query(f"""WITH {DENSITY}, x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM y) WHERE rank <= 20),
s AS (SELECT b.item_id AS query_id, e.vec_id AS chunk_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM benchmark b JOIN embeddings a ON a.vec_id = b.item_id, embeddings e),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 20),
u AS (SELECT query_id, chunk_id, rank, 0 AS list FROM v UNION ALL SELECT query_id, chunk_id, rank, 1 FROM x), f AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS score, min(list * 1000 + rank) AS first FROM u GROUP BY query_id, chunk_id)
SELECT query_id, chunk_id, round(score, 8) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first, chunk_id) AS rank FROM f) WHERE rank <= 10""")
def hybrid_search_all(t):
    """Vector and full-text search fused, for every benchmark item: its whole text, and the vector of its number."""
    asked = _items(t)
    e = t("embeddings").withColumnRenamed("vec_id", "chunk_id")
    vecs = t("benchmark").select(F.col("item_id").alias("chunk_id")).join(e, "chunk_id").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vec"))
    return retrieval.hybrid_search(e, _whole(t), vecs, asked).select("query_id", "chunk_id", F.round("score", 8).alias("score"))


@query("""SELECT doc_id AS chunk_id, 1.0 / (1 + doc_id) AS score, CASE WHEN doc_id % 2 = 0 THEN source WHEN doc_id % 3 = 0 THEN lang END AS origin, CASE WHEN doc_id % 2 = 0 THEN 'vector' ELSE 'text' END AS list FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0""")
def hydrate_fused(t):
    """Fused ids get their columns from the first list that holds them."""
    own = t("documents").withColumnRenamed("doc_id", "chunk_id")
    by_vector = own.filter("chunk_id % 2 = 0").select("chunk_id", F.col("source").alias("origin"), F.lit("vector").alias("list"), F.lit(0.5).alias("score"), F.lit(1).alias("rank"))
    by_text = own.filter("chunk_id % 3 = 0").select("chunk_id", F.col("lang").alias("origin"), F.lit("text").alias("list"), F.lit(0.1).alias("score"), F.lit(1).alias("rank"))
    fused = own.select("chunk_id", (1.0 / (1 + F.col("chunk_id"))).alias("score"))
    return retrieval.hydrate(fused, [by_vector, by_text]).select("chunk_id", "score", "origin", "list")


_UUID = "substr(md5({0}), 1, 8) || '-' || substr(md5({0}), 9, 4) || '-' || substr(md5({0}), 13, 4) || '-' || substr(md5({0}), 17, 4) || '-' || substr(md5({0}), 21, 12)"


@query(f"SELECT doc_id AS chunk_id FROM documents WHERE {_UUID.format('source')} = {_UUID.format(chr(39) + 'src3' + chr(39))} AND doc_id % 7 <> 0")
def filter_one_document(t):
    """Chunks of the document with a given id."""
    own = t("documents").select(F.col("doc_id").alias("chunk_id"), F.expr(_UUID.format("source")).alias("document_id"), F.lit("").alias("section_path"), F.lit("").alias("filename"), F.lit("").alias("category_id"), F.when(F.col("doc_id") % 7 == 0, "deprecated").otherwise("active").alias("status"), F.lit(None).cast("string").alias("chunk_type"))
    import hashlib

    return retrieval.scope(own, document_id=str(uuid.UUID(hashlib.md5(b"src3").hexdigest()))).select("chunk_id")


@query("""SELECT CAST(doc_id AS VARCHAR) AS chunk_id, source AS filename, CAST(3 AS INT) AS version FROM documents WHERE CAST(substr(source, 4) AS BIGINT) % 4 <> 0 AND doc_id % 5 <> 2 AND lang IN ('en', 'de')""")
def engine_scope(t):
    """Chunks joined with their documents within the engine's filters, read from the catalog."""
    d = t("documents")
    catalog = _catalog(d)
    heads = d.select("source").distinct()
    catalog.write("documents", heads.crossJoin(F.broadcast(d.select("lang").distinct())).select(F.concat_ws("/", "source", "lang").alias("id"), F.col("source").alias("filename"), F.lit(3).alias("version"), F.when(F.substring("source", 4, 9).cast("long") % 4 == 0, "deprecated").otherwise("active").alias("status"), F.col("lang").alias("category_id"), now().alias("ingested_at")))
    kind = F.when(F.col("doc_id") % 5 == 2, "INDEX")
    catalog.write("chunks", d.select(F.col("doc_id").cast("string").alias("id"), F.concat_ws("/", "source", "lang").alias("document_id"), F.lit(0).alias("chunk_index"), F.lit("").alias("content"), _metadata(catalog, kind).alias("metadata")))
    return Engine(catalog).scoped({}, ["en", "de"]).select("chunk_id", "filename", "version")


def _metadata(catalog: Catalog, chunk_type):
    """The metadata struct of a chunk with nothing but its type."""
    kind = catalog.read("chunks").schema["metadata"].dataType
    return F.struct(*[(chunk_type if f.name == "chunk_type" else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])


# Answers

@query("""WITH r AS (SELECT source AS query_id, lpad(CAST(doc_id AS VARCHAR), 14, '0') AS id, doc_id AS seq, CAST(doc_id % 3 AS INT) AS version, n_chars % 2 = 0 AS has_table, CAST(n_chars AS DOUBLE) AS score FROM documents),
l AS (SELECT query_id, substr(id, 1, 12) AS name, arg_max(id, seq) AS id FROM r GROUP BY ALL), p AS (SELECT r.query_id, r.id AS a_id, l.id AS b_id FROM r JOIN l ON l.query_id = r.query_id AND l.name = substr(r.id, 1, 12) WHERE r.seq % 5 = 0 AND r.id <> l.id)
SELECT p.query_id, a_id, b_id, CASE WHEN a.version <> b.version THEN CASE WHEN a.version > b.version THEN a_id ELSE b_id END WHEN a.has_table <> b.has_table THEN CASE WHEN a.has_table THEN a_id ELSE b_id END WHEN a.score >= b.score THEN a_id ELSE b_id END AS winner_id,
 CASE WHEN a.version <> b.version THEN 'version' WHEN a.has_table <> b.has_table THEN 'table' ELSE 'score' END AS rule FROM p JOIN r a ON a.id = p.a_id JOIN r b ON b.id = p.b_id""")
def conflict_pairs(t):
    """Pairs of chunk ids, one of them by its first 12 characters: of chunks that share these the last counts."""
    own = t("documents")
    key = F.lpad(F.col("doc_id").cast("string"), 14, "0")
    rows = own.select(F.col("source").alias("query_id"), key.alias("chunk_id"), F.col("doc_id").alias("seq"), (F.col("doc_id") % 3).cast("int").alias("version"), F.lit(None).cast("string").alias("ingested_at"), (F.col("n_chars") % 2 == 0).alias("has_table"), F.col("n_chars").cast("double").alias("score"))
    pairs = own.filter("doc_id % 5 = 0").select(F.col("source").alias("query_id"), key.alias("a_id"), F.substring(key, 1, 12).alias("b_id"))
    return assembly.resolve_conflicts(pairs, rows)


@query("""WITH o AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn % 3 = 1 DESC, length(text) DESC, turn) AS pos,
 '[' || substr('chunk-' || conv_id || '-' || turn, 1, 12) || '] (file: ' || role || ', section: s' || turn || ')' || chr(10) || text AS entry FROM conversations),
w AS (SELECT *, sum(length(entry) + 2) OVER (PARTITION BY conv_id ORDER BY pos) - 2 AS used FROM o), c AS (SELECT conv_id, string_agg(entry, chr(10) || chr(10) ORDER BY pos) AS context FROM w WHERE used <= 1200 GROUP BY conv_id)
SELECT DISTINCT x.conv_id, sha256(coalesce(c.context, '')) AS digest FROM conversations x LEFT JOIN c ON c.conv_id = x.conv_id""")
def context_text(t):
    """The context of each query as text, within its budget of characters."""
    rows = t("conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("seq"), F.concat_ws("-", F.lit("chunk"), "conv_id", "turn").alias("chunk_id"), F.col("role").alias("filename"), F.concat(F.lit("s"), "turn").alias("section_path"), F.col("text").alias("content"), F.length("text").alias("score"), F.when(F.col("turn") % 3 == 1, "DEFINITION").alias("chunk_type"))
    return assembly.context(rows, EngineConfig(context_tokens=300)).select(F.col("query_id").alias("conv_id"), F.sha2(F.col("context").cast("binary"), 256).alias("digest"))


@query(f"""SELECT sha256(text || conv_id || '-' || turn || '|' || '{CLOCK}') AS id, TIMESTAMP '{CLOCK}' + INTERVAL 24 HOUR AS expires_at, CAST(turn AS BIGINT) AS turn FROM conversations WHERE turn > 0 AND conv_id % 9 <> 0 AND turn % 5 <> 4""")
def cache_insert(t):
    """Results that are worth keeping as rows of the cache, with the time they expire."""
    own = t("conversations").select(F.concat("text", F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("query"), F.array(F.lit(1.0)).alias("vec"), F.lit("An answer.").alias("answer"), F.col("turn").alias("n_chunks"), F.when(F.col("conv_id") % 9 == 0, "x").alias("error"), (F.col("turn") % 5 == 4).alias("skipped"), F.struct("turn").alias("result"))
    return assembly.cache_rows(own, now()).select("id", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"), F.get_json_object("result_json", "$.turn").cast("long").alias("turn"))


@query("""SELECT date_trunc('hour', ts) AS hour, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def log_rollup(t):
    """The streaming roll-up on a table; on a stream, windows close by the watermark."""
    own = logs.rollup(t("events").withColumn("at", F.col("ts").cast("timestamp")), "at", "event_type", "value")
    return own.select(F.col("start").cast("timestamp_ntz").alias("hour"), F.col("event_type").alias("kind"), "n", F.round("total", 4).alias("total"))


# Listings and the catalog

@query("""WITH k AS (SELECT source AS filename, sha256(arg_min(text, doc_id)) AS content_hash FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY source),
f AS (SELECT doc_id AS seq, source AS filename, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL AND source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1)
SELECT filename, seq, content_hash, CASE WHEN filename IN (SELECT filename FROM k) THEN 3 ELSE 0 END + row_number() OVER (PARTITION BY filename ORDER BY seq) AS version FROM f WHERE content_hash NOT IN (SELECT content_hash FROM k)""")
def version_by_stream(t):
    """Documents arrive in two mixed batches; their versions come from keyed state, after three of each name that are known."""
    d = t("documents").filter("text is not null and source is not null")
    own = d.select(F.col("doc_id").alias("seq"), F.col("source").alias("filename"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.timestamp_seconds("doc_id").alias("at"))
    known = d.groupBy(F.col("source").alias("filename")).agg(F.min_by("text", "doc_id").alias("text")).select("filename", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.lit(3).alias("version"))
    ends = d.agg(F.coalesce(F.min("doc_id"), F.lit(0)).alias("low"), F.coalesce(F.max("doc_id"), F.lit(0)).alias("high")).first()
    span = ends["high"] - ends["low"] + 1
    spark = d.sparkSession
    root = f"{_catalog(d).root}-stream"
    last = spark.range(1).select(F.lit(-1).cast("long").alias("seq"), F.lit("").alias("filename"), F.lit("").alias("content_hash"), F.timestamp_seconds(F.lit(ends["high"] + 2 * span)).alias("at"))
    # Nothing is late, for the watermark stays behind the first file until one comes that follows all others.
    for batch in (own.filter("seq % 2 = 0"), own.filter("seq % 2 = 1").unionByName(last)):
        batch.write.mode("append").parquet(f"{root}/in")
        told = version_stream(spark.readStream.schema(own.schema).parquet(f"{root}/in"), f"{span} seconds", known)
        told.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(VERSION).parquet(f"{root}/out").filter("seq >= 0").select("filename", "seq", "content_hash", "version")


@query("""WITH l AS (SELECT n_nationkey, n_regionkey AS k FROM nation UNION SELECT n_nationkey, n_nationkey % 5 FROM nation WHERE n_nationkey % 7 <> 0)
SELECT n.n_name AS agent, coalesce((SELECT string_agg(r_name, ',' ORDER BY r_name) FROM l JOIN region ON r_regionkey = l.k WHERE l.n_nationkey = n.n_nationkey AND n.n_nationkey % 6 <> 0), '') AS categories FROM nation n""")
def agents_listing(t):
    n = t("nation")
    agents = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), now().alias("created_at"))
    both = n.select(F.col("n_nationkey").alias("agent_id"), F.col("n_regionkey").cast("long").alias("category_id")).union(n.filter("n_nationkey % 7 <> 0").select("n_nationkey", (F.col("n_nationkey") % 5).cast("long"))).distinct()
    names = t("region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    listed = listings.agents(agents, both.filter("agent_id % 6 <> 0"), names)
    return listed.select(F.col("name").alias("agent"), F.coalesce(F.array_join(F.transform("categories", lambda c: c["category_name"]), ","), F.lit("")).alias("categories"))


@query("""SELECT 'messages' AS "table", count(*) FILTER (WHERE conv_id % 3 <> 0) AS rows FROM conversations UNION ALL SELECT 'conversations', count(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'query_logs', 2 * count(*) FROM region UNION ALL SELECT 'categories', 0""")
def catalog_lifecycle(t):
    """Tables of the catalog after writes, appends, keyed upserts, a delete and a truncation."""
    own = t("conversations")
    catalog = _catalog(own)
    turns = own.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("conversation_id"), F.lit("user").alias("role"), F.col("text").alias("content"), now().alias("created_at"))
    catalog.write("messages", turns)
    catalog.upsert("messages", turns.withColumn("role", F.lit("assistant")))
    catalog.delete("messages", F.col("conversation_id").cast("long") % 3 == 0)
    catalog.write("conversations", own.select(F.col("conv_id").cast("string").alias("id"), now().alias("created_at")).distinct())
    names = t("region").select(F.col("r_name").alias("id"), F.col("r_name").alias("name"), F.col("r_name").alias("query"))
    catalog.append("query_logs", names)
    catalog.append("query_logs", names)
    catalog.write("categories", names)
    catalog.truncate("categories")
    return catalog.counts("messages", "conversations", "query_logs", "categories")


@query("""SELECT 'agent' AS kind, 'Second' AS name, 'beta' AS detail UNION ALL SELECT 'category', 'beta', '1' UNION ALL SELECT 'conversation', 'Renamed', '2' UNION ALL SELECT 'log', 'hello?', 'SIMPLE'
UNION ALL SELECT 'document', 'page-' || page_id, CASE WHEN page_id = (SELECT min(page_id) FROM pages) THEN 'beta' END FROM pages UNION ALL SELECT 'error', 'conflict', 'category beta exists' UNION ALL SELECT 'error', 'missing', 'no row nobody in agents'""")
def service_lifecycle(t):
    """What the service lists after categories, agents, a conversation and a document were made and changed."""
    from quillgraph.plans.service import Conflict, NotFound

    pages = t("pages")
    service = Service(_catalog(pages), config=EngineConfig(text_dim=32, part_dim=8, max_passes=1), clock=now())
    spark, catalog = pages.sparkSession, service.catalog
    catalog.write("documents", pages.select(F.concat(F.lit("page-"), "page_id").alias("id"), F.concat(F.lit("page-"), "page_id").alias("filename"), F.lit("active").alias("status"), F.lit(1).alias("version")))
    document = f"page-{pages.agg(F.min('page_id')).first()[0]}"
    alpha, beta = service.create_category("alpha"), service.create_category("beta")
    service.move_document(document, beta)
    one, two = service.create_agent("First", categories=[alpha]), service.create_agent("Other", categories=[alpha])
    service.update_agent(two, categories=[beta], name="Second")
    service.delete_agent(one)
    service.delete_category(alpha)
    talk = service.create_conversation()
    service.query("hello?", talk)
    service.rename_conversation(talk, "Renamed")
    errors = []
    for kind, work in (("conflict", lambda: service.create_category("beta")), ("missing", lambda: service.agent("nobody"))):
        try:
            work()
        except (Conflict, NotFound) as problem:
            errors.append(("error", kind, str(problem)))
    rows = spark.createDataFrame(errors, "kind string, name string, detail string")
    agents = service.agents().select(F.lit("agent").alias("kind"), "name", F.array_join(F.transform("categories", lambda c: c["category_name"]), ",").alias("detail"))
    categories = service.categories().select(F.lit("category").alias("kind"), "name", F.col("document_count").cast("string").alias("detail"))
    talks = service.conversations().select(F.lit("conversation").alias("kind"), F.col("title").alias("name"), F.col("message_count").cast("string").alias("detail"))
    asked = catalog.read("query_logs").select(F.lit("log").alias("kind"), F.col("query").alias("name"), F.col("query_type").alias("detail"))
    documents = service.documents().select(F.lit("document").alias("kind"), F.col("filename").alias("name"), F.col("category_name").alias("detail"))
    return rows.unionByName(agents).unionByName(categories).unionByName(talks).unionByName(asked).unionByName(documents)


@query("""WITH f AS (SELECT page_id AS arrived, 'p' || (page_id // 2) || CASE WHEN page_id % 11 = 5 THEN '.exe' ELSE '.html' END AS filename, sha256(html) AS h FROM pages), g AS (SELECT *, filename NOT LIKE '%.exe' AS ok FROM f),
u AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY arrived, filename) AS turn FROM g WHERE ok), n AS (SELECT arrived, row_number() OVER (PARTITION BY filename ORDER BY arrived) AS version, lead(arrived) OVER (PARTITION BY filename ORDER BY arrived) IS NULL AS latest, h FROM u WHERE turn = 1)
SELECT g.filename, CAST(v.version AS INT) AS version, CASE WHEN ok THEN CASE WHEN v.latest THEN 'active' ELSE 'deprecated' END END AS kept, CASE WHEN NOT ok THEN 'failed' ELSE 'completed' END AS status, CASE WHEN NOT ok THEN 'parse' ELSE 'save' END AS step FROM g LEFT JOIN n v ON v.h = g.h AND ok""")
def ingest_batch(t):
    """A batch of files through the whole of ingestion: versions by arrival, failures that stop nothing, and the log."""
    pages = t("pages")
    rows = pages.select(F.concat(F.lit("p"), F.expr("page_id div 2").cast("string"), F.when(F.col("page_id") % 11 == 5, ".exe").otherwise(".html")).alias("path"), F.octet_length("html").cast("long").alias("length"), F.col("html").cast("binary").alias("content"), F.col("page_id").alias("arrived"))
    catalog = _catalog(pages)
    told = lambda content: {"entities": [], "relationships": []}
    done = ingest.Ingestion(catalog, Providers(extract=told), EngineConfig(text_dim=32, part_dim=8), now()).ingest(rows)
    kept = catalog.read("documents").select("id", F.col("status").alias("kept"))
    steps = catalog.read("ingestion_logs").select("filename", "status", "step").distinct()
    return done.select("filename", "id", "version", "status").join(kept, "id", "left").join(steps, ["filename", "status"]).select("filename", "version", "kept", "status", "step")


@query("""SELECT * FROM (VALUES ('list leave rules', 'SIMPLE', 1, false, 2), ('list leave rules', 'SIMPLE', 0, true, 2), ('compare the two', 'ANALYTICAL', 2, false, 2)) AS v(query, query_type, passes, cached, chunks)""")
def answer_batch(t):
    """Questions through all steps: another pass where coverage is poor, and the cache for what was asked before."""
    d = t("documents")
    catalog = _catalog(d)
    heads = d.groupBy("source").agg(F.min_by("text", "doc_id").alias("text"))
    catalog.write("documents", heads.select(F.col("source").alias("id"), F.col("source").alias("filename"), F.lit(1).alias("version"), F.lit("active").alias("status"), now().alias("ingested_at")))
    catalog.write("chunks", heads.filter("source in ('src1', 'src2')").select(F.col("source").alias("id"), F.col("source").alias("document_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"), F.lit("s").alias("section_path"), F.lit(False).alias("has_table"), _metadata(catalog, F.lit("PARAGRAPH")).alias("metadata")))
    embed = Providers().embed
    catalog.write("chunk_embeddings", catalog.read("chunks").select(F.col("id").alias("chunk_id"), embed("content", 32).alias("embedding")).withColumn("hybrid", vectors.query_hybrid("embedding", 32, 8)))
    # Two chunks are too few for an analytical question, so there is another pass, as often as the settings allow.
    providers = Providers(answer=lambda query, context, calculation, history, prompt: f"found {len(context) > 0}")
    engine = Engine(catalog, providers, EngineConfig(text_dim=32, part_dim=8), now())
    told = [engine.query(q) for q in ("list leave rules", "list leave rules", "compare the two")]
    rows = [(a.query, a.query_type, a.passes, a.cached, len(a.chunks)) for a in told]
    return d.sparkSession.createDataFrame(rows, "query string, query_type string, passes int, cached boolean, chunks int")


@query("""WITH q AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'SIMPLE' WHEN 1 THEN 'ANALYTICAL' ELSE 'GRAPH' END AS query_type, lower(CASE item_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'compare ' ELSE 'how is it connected: ' END || text) AS l FROM benchmark WHERE text IS NOT NULL),
d AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, '[' || substr(CAST(doc_id AS VARCHAR), 1, 12) || '] (file: ' || source || ', section: ' || lang || ')' || chr(10) || substr(text, 1, 4096) AS entry, lower(text) AS l FROM documents WHERE text IS NOT NULL),
a AS (SELECT item_id, query_type, list_transform(range(97, 123), lambda x: CAST(length(l) - length(replace(l, chr(CAST(x AS INT)), '')) AS DOUBLE)) AS v FROM q),
b AS (SELECT chunk_id, entry, list_transform(range(97, 123), lambda x: CAST(length(l) - length(replace(l, chr(CAST(x AS INT)), '')) AS DOUBLE)) AS v FROM d),
c AS (SELECT chunk_id, entry, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM b), e AS (SELECT chunk_id, entry, CAST(list_transform(v, lambda x: x / n) AS FLOAT[]) AS v FROM c WHERE n > 0),
s AS (SELECT item_id, query_type, chunk_id, entry, row_number() OVER (PARTITION BY item_id ORDER BY list_cosine_similarity(a.v, CAST(e.v AS DOUBLE[])) DESC, chunk_id) AS rank FROM a, e)
SELECT item_id, query_type, string_agg(chunk_id, ',' ORDER BY rank) AS chunk_ids, substr(min(entry) FILTER (WHERE rank = 1), 1, 60) AS answer, query_type = 'SIMPLE' AS covered FROM s WHERE rank <= 10 GROUP BY item_id, query_type""")
def answer_all_items(t):
    """Every benchmark item as a question over all documents, in one batch; vectors count letters, so that SQL can follow them."""
    d = t("documents").filter("text is not null")
    catalog = _catalog(d)
    key = F.col("doc_id").cast("string")
    catalog.write("documents", d.select(key.alias("id"), F.col("source").alias("filename"), F.lit(1).alias("version"), F.lit("active").alias("status"), now().alias("ingested_at")))
    catalog.write("chunks", d.select(key.alias("id"), key.alias("document_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"), F.col("lang").alias("section_path"), F.lit(False).alias("has_table"), _metadata(catalog, F.lit("PARAGRAPH")).alias("metadata")))

    def letters(column, dim):
        low = F.lower(F.col(column) if isinstance(column, str) else column)
        return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(chr(x)), F.lit("")))).cast("double") for x in range(97, 123)])

    embedded = catalog.read("chunks").select(F.col("id").alias("chunk_id"), letters("content", 26).alias("embedding"))
    catalog.write("chunk_embeddings", embedded.withColumn("hybrid", vectors.query_hybrid("embedding", 26, 8)))
    providers = Providers(embed=letters, answer=lambda query, context, calculation, history, prompt: context[:60])
    engine = Engine(catalog, providers, EngineConfig(text_dim=26, part_dim=8), now())
    opening = F.element_at(F.array(F.lit(""), F.lit("compare "), F.lit("how is it connected: ")), (F.col("item_id") % 3 + 1).cast("int"))
    asked = t("benchmark").filter("text is not null").select(F.col("item_id").alias("query_id"), F.concat(opening, "text").alias("query"))
    told = batch.answer_all(engine, asked)
    return told.select(F.col("query_id").cast("long").alias("item_id"), "query_type", F.array_join("chunk_ids", ",").alias("chunk_ids"), "answer", "covered")

"""The knowledge graph as two tables: entities (name, type, ...) and relationships with an ``edge_id`` each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.config import DEFAULT, EngineConfig
from quillgraph.functions.text import normalize_name
from quillgraph.sources.catalog import settled


def _merged_maps(rows: str) -> Column:
    """Maps of an array of (seq, properties) in order, later ones winning."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    later = lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    in_order = F.array_sort(rows, lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0))
    return F.aggregate(in_order, empty, lambda s, r: later(s, F.coalesce(r["properties"], empty)))


def dedup_entities(entities: DataFrame) -> DataFrame:
    """One row for each normalised name and type: the row of highest confidence (first by ``seq``) with all properties."""
    own = entities.withColumn("norm_name", normalize_name("name"))
    kept = [c for c in entities.columns if c not in ("type", "properties")]
    best = F.max_by(F.struct(*kept), F.struct(F.col("confidence"), -F.col("seq"))).alias("best")
    merged = own.groupBy("norm_name", "type").agg(best, F.collect_list(F.struct("seq", "properties")).alias("all"), F.min("seq").alias("first_seq"))
    return merged.select("norm_name", "type", *[F.col("best")[c].alias(c) for c in kept], _merged_maps("all").alias("properties"), "first_seq")


def dedup_relationships(relationships: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """One row for each normalised source, target and type: the highest confidence, first by ``seq``.

    With ``entities``, endpoints take the spelling that the entity of that normalised name has.
    """
    own = relationships.withColumn("ns", normalize_name("source_entity")).withColumn("nt", normalize_name("target_entity"))
    order = Window.partitionBy("ns", "nt", "type").orderBy(F.desc("confidence"), "seq")
    own = own.withColumn("__turn", F.row_number().over(order)).filter("__turn = 1").drop("__turn")
    if entities is not None:
        names = entities.groupBy(normalize_name("name").alias("n")).agg(F.min_by("name", "type").alias("canonical"))
        for side, key in (("source_entity", "ns"), ("target_entity", "nt")):
            own = own.join(names.withColumnRenamed("n", key), key, "left").withColumn(side, F.coalesce("canonical", side)).drop("canonical")
    return own.drop("ns", "nt")


def merge_entities(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by (name, type): documents are appended, confidence never falls, properties are replaced, rows become active."""
    e, n = existing.alias("e"), new.alias("n")
    both = e.join(n, (F.col("e.name") == F.col("n.name")) & (F.col("e.type") == F.col("n.type")), "full_outer")
    found, known = F.col("n.name").isNotNull(), F.col("e.name").isNotNull()
    docs = F.when(found & known, F.array_union(F.coalesce("e.source_document_ids", F.array().cast("array<string>")), F.array("n.source_document_id"))).when(found, F.array("n.source_document_id")).otherwise(F.col("e.source_document_ids"))
    return both.select(
        F.coalesce("e.name", "n.name").alias("name"),
        F.coalesce("e.type", "n.type").alias("type"),
        docs.alias("source_document_ids"),
        F.when(known, F.col("e.source_chunk_index")).otherwise(F.col("n.source_chunk_index")).alias("source_chunk_index"),
        F.greatest("e.confidence", "n.confidence").alias("confidence"),
        F.when(found, F.col("n.properties")).otherwise(F.col("e.properties")).alias("properties"),
        F.when(found, F.lit("active")).otherwise(F.col("e.status")).alias("status"),
        F.col("e.community_id").alias("community_id"),
    )


def edge_id(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *columns), 256)


def merge_relationships(existing: DataFrame, new: DataFrame, entities: DataFrame) -> DataFrame:
    """Upsert by (source, type, target). Ends are found by name alone, in every type and status; others are dropped."""
    src = entities.select(F.col("name").alias("source_entity"), F.col("type").alias("src_type"))
    dst = entities.select(F.col("name").alias("target_entity"), F.col("type").alias("dst_type"))
    made = new.join(src, "source_entity").join(dst, "target_entity").select(
        F.col("source_entity").alias("src_name"), "src_type", F.col("target_entity").alias("dst_name"), "dst_type", F.col("type").alias("rel_type"), "source_document_id", "source_chunk_index", "confidence", "properties"
    )
    made = made.withColumn("edge_id", edge_id("src_name", "src_type", "rel_type", "dst_name", "dst_type"))
    e, n = existing.alias("e"), made.alias("n")
    both = e.join(n, "edge_id", "full_outer")
    found = F.col("n.src_name").isNotNull()
    columns = ["src_name", "src_type", "dst_name", "dst_type", "rel_type", "source_document_id", "source_chunk_index", "properties"]
    return both.select("edge_id", *[F.when(found, F.col(f"n.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in columns], F.greatest("e.confidence", "n.confidence").alias("confidence"))


def deprecate_document(entities: DataFrame, document_id: str, chunk_indices: list[int] | None = None) -> DataFrame:
    """Entities of a document (or of some of its chunks) become deprecated; none is deleted."""
    hit = F.array_contains("source_document_ids", document_id)
    if chunk_indices is not None:
        hit = hit & F.col("source_chunk_index").isin(*chunk_indices) if chunk_indices else F.lit(False)
    return entities.withColumn("status", F.when(F.coalesce(hit, F.lit(False)), "deprecated").otherwise(F.col("status")))


def migrate_entities(entities: DataFrame, scalar: str = "source_document_id") -> DataFrame:
    """Old rows: a scalar document id becomes a list, a missing status active."""
    return entities.withColumn("source_document_ids", F.coalesce("source_document_ids", F.when(F.col(scalar).isNotNull(), F.array(scalar)))).withColumn("status", F.coalesce("status", F.lit("active")))


def active_edges(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Edges with both ends active, with weights; the read that graph analytics starts from."""
    live = entities.filter("status = 'active'").select("name", "type")
    src = live.select(F.col("name").alias("src_name"), F.col("type").alias("src_type"))
    dst = live.select(F.col("name").alias("dst_name"), F.col("type").alias("dst_type"))
    return relationships.join(src, ["src_name", "src_type"], "left_semi").join(dst, ["dst_name", "dst_type"], "left_semi").withColumn("weight", F.coalesce("confidence", F.lit(1.0)))


def both_ways(relationships: DataFrame) -> DataFrame:
    """(edge_id, a_*, b_*, rel_type): each edge from either end; a self-loop once."""
    there = relationships.select("edge_id", F.col("src_name").alias("a_name"), F.col("src_type").alias("a_type"), F.col("dst_name").alias("b_name"), F.col("dst_type").alias("b_type"), "rel_type")
    back = relationships.select("edge_id", F.col("dst_name").alias("a_name"), F.col("dst_type").alias("a_type"), F.col("src_name").alias("b_name"), F.col("src_type").alias("b_type"), "rel_type").filter("a_name <> b_name or a_type <> b_type")
    return there.unionByName(back)


def degrees(nodes: DataFrame, relationships: DataFrame) -> DataFrame:
    """(name, type, degree); 0 for nodes without edges."""
    count = both_ways(relationships).groupBy(F.col("a_name").alias("name"), F.col("a_type").alias("type")).agg(F.count("edge_id").alias("degree"))
    return nodes.select("name", "type").join(count, ["name", "type"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def choose_seeds(seeds: DataFrame, entities: DataFrame, relationships: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(query_id, name, pos): seeds without repeats in another case and without hubs; the least hub if all are."""
    first = Window.partitionBy("query_id", F.lower("name")).orderBy("pos")
    own = seeds.withColumn("__turn", F.row_number().over(first)).filter("__turn = 1").drop("__turn")
    live = entities.filter("status = 'active'").join(own.select("name").distinct(), "name", "left_semi")
    # The degree is looked up by the seed's own spelling, so another spelling counts as 0.
    degree = degrees(live, relationships).groupBy("name").agg(F.max("degree").alias("degree"))
    own = own.join(degree, "name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    query = Window.partitionBy("query_id")
    own = own.withColumn("__some", F.max((F.col("degree") <= config.max_degree).cast("int")).over(query))
    own = own.withColumn("__turn", F.row_number().over(query.orderBy("degree", "pos")))
    return own.filter(((F.col("__some") == 1) & (F.col("degree") <= config.max_degree)) | ((F.col("__some") == 0) & (F.col("__turn") == 1))).select("query_id", "name", "pos")


def first_neighbours(steps: DataFrame, live: DataFrame, k: int) -> DataFrame:
    """(m_name, m_type, name): of each node the first ``k`` names of active neighbours.

    Names are cut to the first ``k`` of each part of a node's edges before those meet, so a hub is no single task.
    """
    ends = steps.select(F.col("a_name").alias("m_name"), F.col("a_type").alias("m_type"), F.col("b_name").alias("name"), F.col("b_type").alias("type"))
    names = ends.join(live, ["name", "type"], "left_semi").select("m_name", "m_type", "name").distinct().withColumn("part", F.pmod(F.xxhash64("name"), F.lit(64)))
    part = Window.partitionBy("m_name", "m_type", "part").orderBy("name")
    few = names.withColumn("turn", F.row_number().over(part)).filter(F.col("turn") <= k)
    whole = Window.partitionBy("m_name", "m_type").orderBy("name")
    return few.withColumn("turn", F.row_number().over(whole)).filter(F.col("turn") <= k).select("m_name", "m_type", "name")


def second_hops(one: DataFrame, near: DataFrame, steps: DataFrame, live: DataFrame, most: int) -> DataFrame:
    """(query_id, seed_name, name): pairs that may be among the best ``most`` of their query by two edges, in order of names.

    Of a middle's neighbours a query can use ``most`` names besides those it has at one edge (fewer than ``most``, or it needs
    no second edge) and the seed's own; so each middle offers 2 * most + 1 names, however many edges it has.
    """
    frontier = one.join(near, "query_id").select("query_id", "s_name", "s_type", F.col("b_name").alias("m_name"), F.col("b_type").alias("m_type")).distinct()
    middles = frontier.select(F.col("m_name").alias("a_name"), F.col("m_type").alias("a_type")).distinct()
    lists = first_neighbours(steps.join(middles, ["a_name", "a_type"], "left_semi"), live, 2 * most + 1)
    return frontier.join(lists, ["m_name", "m_type"]).select("query_id", F.col("s_name").alias("seed_name"), "name").distinct()


def best_ends(steps: DataFrame, live: DataFrame) -> DataFrame:
    """(m_name, m_type, name, type, r2): of each node the names of active neighbours, each with its least relation type and then type."""
    ends = steps.select(F.col("a_name").alias("m_name"), F.col("a_type").alias("m_type"), F.col("b_name").alias("name"), F.col("b_type").alias("type"), F.col("rel_type").alias("r2"))
    own = ends.join(live, ["name", "type"], "left_semi").groupBy("m_name", "m_type", "name").agg(F.min(F.struct("r2", "type")).alias("end"))
    return own.select("m_name", "m_type", "name", F.col("end.type").alias("type"), F.col("end.r2").alias("r2"))


def whole_hops(frontier: DataFrame, direct: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows of ``traverse`` at two edges, for seeds with a single middle whose queries take all that they find.

    What lies behind a middle is found once and repeated for each seed of it; the rows, of which there may be as many as seeds times
    neighbours, are neither shuffled nor ranked. Seeds and neighbours meet by a part of the neighbours too, so a hub is no single task.
    """
    parts = 64
    known = direct.select("query_id", F.col("seed_name").alias("s_name"), F.col("name").alias("m_name"), F.lit(True).alias("__known"))
    # The middle is all that such a seed has at one edge.
    own = frontier.join(known, ["query_id", "s_name", "m_name"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = ends.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(parts)).cast("int"))
    met = own.join(dealt, ["m_name", "m_type", "part"]).filter((F.col("name") != F.col("s_name")) & (F.col("__known").isNull() | (F.col("name") != F.col("m_name"))))
    return met.select("query_id", F.col("s_name").alias("seed_name"), "name", "type", F.lit(0.5).alias("hop_weight"), F.array("r1", "r2").alias("rel_types"))


def traverse(seeds: DataFrame, entities: DataFrame, relationships: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(query_id, seed_name, name, type, hop_weight, rel_types): what lies one or two edges from the seeds.

    Edges have no direction and aren't used twice in a path; the far end is active and not the seed, the middle may be anything.
    One row for each pair of names: the largest weight, then the least relation types. The best ``max_paths`` stay.

    Pairs at one edge come first. Only queries that have too few of them look further, and take names before paths: the second edge is followed
    for the names that each middle offers, the best pairs are chosen, and the paths of those alone are made. Nothing has to be chosen for a query
    that can't have more than ``max_paths`` of them; see ``whole_hops``.
    """
    most = config.max_paths
    live = entities.filter("status = 'active'").select("name", "type")
    start = live.withColumn("key", F.lower("name")).join(seeds.select("query_id", F.lower("name").alias("key")).distinct(), "key").select("query_id", F.col("name").alias("s_name"), F.col("type").alias("s_type"))
    steps = both_ways(relationships)
    one = settled(start.join(steps, (F.col("s_name") == F.col("a_name")) & (F.col("s_type") == F.col("a_type"))).select("query_id", "s_name", "s_type", "edge_id", "b_name", "b_type", F.array("rel_type").alias("rel_types")))

    def best(paths: DataFrame, weight: float) -> DataFrame:
        own = paths.join(live, ["name", "type"], "left_semi").filter("name <> s_name or type <> s_type")
        own = own.groupBy("query_id", F.col("s_name").alias("seed_name"), "name").agg(F.min(F.struct("rel_types", "type")).alias("best"))
        return own.select("query_id", "seed_name", "name", F.col("best.type").alias("type"), F.lit(weight).alias("hop_weight"), F.col("best.rel_types").alias("rel_types"))

    order = Window.partitionBy("query_id").orderBy("seed_name", "name")
    direct = settled(best(one.select("query_id", "s_name", "s_type", F.col("b_name").alias("name"), F.col("b_type").alias("type"), "rel_types"), 1.0).withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= most))
    have = direct.groupBy("query_id").agg(F.max("turn").alias("have"))
    near = one.select("query_id").distinct().join(have, "query_id", "left").select("query_id", F.coalesce("have", F.lit(0)).alias("have")).filter(F.col("have") < most)
    # A seed goes as a whole if its query's middles have few enough neighbours, it has one middle, and no neighbour has its name in another type.
    edge = ["query_id", "s_name", "s_type"]
    frontier = one.join(near.select("query_id"), "query_id", "left_semi").groupBy(*edge, F.col("b_name").alias("m_name"), F.col("b_type").alias("m_type")).agg(F.min(F.struct(F.col("rel_types")[0].alias("r1")))["r1"].alias("r1"))
    fan = steps.groupBy(F.col("a_name").alias("m_name"), F.col("a_type").alias("m_type")).agg(F.count(F.lit(1)).alias("fan"))
    frontier = frontier.join(fan, ["m_name", "m_type"])
    bound = frontier.groupBy("query_id").agg(F.sum("fan").alias("most")).join(near, "query_id").filter(F.col("most") + F.col("have") <= most).select("query_id")
    twins = live.groupBy("name").agg(F.count(F.lit(1)).alias("types")).filter("types > 1").select(F.col("name").alias("s_name"))
    alone = frontier.join(bound, "query_id", "left_semi").groupBy("query_id", "s_name").agg(F.count(F.lit(1)).alias("middles")).filter("middles = 1").join(twins, "s_name", "left_anti")
    easy = settled(frontier.join(alone.select("query_id", "s_name"), ["query_id", "s_name"], "left_semi").drop("fan"))
    one = one.join(easy.select("query_id", "s_name"), ["query_id", "s_name"], "left_anti")
    pairs = settled(second_hops(one, near, steps, live, most).join(direct.select("query_id", "seed_name", "name"), ["query_id", "seed_name", "name"], "left_anti"))
    first = one.join(pairs.withColumnRenamed("seed_name", "s_name"), ["query_id", "s_name"])
    hop = steps.select(F.col("edge_id").alias("e2"), F.col("a_name").alias("b_name"), F.col("a_type").alias("b_type"), F.col("b_name").alias("name"), F.col("b_type").alias("type"), F.col("rel_type").alias("r2"))
    two = first.join(hop, ["b_name", "b_type", "name"]).filter("edge_id <> e2").select("query_id", "s_name", "s_type", "name", "type", F.concat("rel_types", F.array("r2")).alias("rel_types"))
    after = best(two, 0.5).join(near, "query_id").withColumn("turn", F.row_number().over(order)).filter(F.col("turn") + F.col("have") <= most)
    found = direct.drop("turn").unionByName(after.drop("turn", "have"))
    if easy.isEmpty():
        return found
    behind = steps.join(easy.select(F.col("m_name").alias("a_name"), F.col("m_type").alias("a_type")).distinct(), ["a_name", "a_type"], "left_semi")
    return found.unionByName(whole_hops(easy, direct, best_ends(behind, live)))


def resolve_chunks(paths: DataFrame, seeds: DataFrame, entities: DataFrame, chunks: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(query_id, chunk_id, score, rank): chunks that paths' ends and seeds come from, weighted by hops.

    ``chunks`` are those in scope. Without a chunk from any path there are none from seeds either.
    """
    own = entities.filter("source_chunk_index is not null")
    ends = paths.join(own, ["name", "type"]).select("query_id", F.explode("source_document_ids").alias("document_id"), F.col("source_chunk_index").alias("chunk_index"), "hop_weight")
    live = own.filter("status = 'active'").withColumn("key", F.lower("name"))
    start = seeds.select("query_id", F.lower("name").alias("key")).distinct().join(live, "key").select("query_id", F.get("source_document_ids", F.lit(0)).alias("document_id"), F.col("source_chunk_index").alias("chunk_index"), F.lit(None).cast("double").alias("hop_weight"))
    start = start.filter("document_id is not null").join(ends.select("query_id").distinct(), "query_id", "left_semi")
    wanted = ends.unionByName(start).groupBy("query_id", "document_id", "chunk_index").agg(F.coalesce(F.max("hop_weight"), F.lit(0.5)).alias("score"))
    found = wanted.join(chunks, ["document_id", "chunk_index"])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id", "chunk_index")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= config.graph_top_k)


def _grams(column: str, size: int) -> Column:
    """The distinct parts of ``size`` characters; none of a shorter text."""
    places = F.sequence(F.lit(1), F.greatest(F.length(column) - size + 1, F.lit(1)))
    return F.when(F.length(column) >= size, F.array_distinct(F.transform(places, lambda i: F.substring(F.col(column), i, F.lit(size)))))


def match_names(names: DataFrame, entities: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, wanted, name, type): up to ``most`` active entities whose name contains the wanted one, in any case.

    ``names`` may be many: wanted names and entities meet by a part of three characters, of each wanted name the one that the fewest
    entities have, and are then compared. A wanted name of one or two characters is its own part; an empty one is in every name, a null in none.
    Parts are counted where the entities are and chosen first, so that no entity is dealt by a part that nobody chose.
    """
    live = entities.filter("status = 'active' and name is not null").select("name", "type").withColumn("__low", F.lower("name"))
    wanted = names.filter("name is not null").select("query_id", F.col("name").alias("wanted"), F.lower("name").alias("__key"))
    keys = wanted.select("__key").distinct()
    parts = F.concat(*[F.when(F.least(F.length("__key"), F.lit(3)) == n, _grams("__key", n)).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)])
    asked = keys.filter("__key <> ''").select("__key", F.explode(parts).alias("__part"))
    of_names = F.concat(*[F.coalesce(_grams("__low", n), F.array().cast("array<string>")) for n in (1, 2, 3)])
    count = live.select(F.explode(of_names).alias("__part")).groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # A part that no entity has counts as the rarest, and rules its name out.
    rarest = asked.join(count, "__part", "left").groupBy("__key").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)), "__part")).alias("__best"))
    chosen = settled(rarest.select("__key", F.col("__best.__part").alias("__part")))
    postings = live.select("name", "type", "__low", F.explode(of_names).alias("__part"))
    found = chosen.join(postings, "__part").filter(F.contains("__low", "__key")).select("__key", "name", "type")
    order = Window.partitionBy("__key").orderBy("name", "type")
    found = found.withColumn("__turn", F.row_number().over(order)).filter(F.col("__turn") <= most).drop("__turn")
    every = live.orderBy("name", "type").limit(most).select(F.lit("").alias("__key"), "name", "type")
    return wanted.join(found.unionByName(every), "__key").select("query_id", "wanted", "name", "type")


def find_seeds(near: DataFrame, wanted: DataFrame, entities: DataFrame, least: int = 2) -> DataFrame:
    """(query_id, name, pos): the entities nearest to each query, and for queries with fewer than ``least`` also those named in it.

    ``near`` has query_id, name and rank, ``wanted`` query_id and name. Named entities follow the near ones, by wanted name, name and type.
    """
    have = near.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("__have"))
    poor = wanted.select("query_id").distinct().join(have, "query_id", "left").select("query_id", F.coalesce("__have", F.lit(0)).alias("__have")).filter(F.col("__have") < least)
    named = match_names(wanted.join(poor, "query_id", "left_semi").distinct(), entities).join(poor, "query_id")
    named = named.withColumn("pos", F.col("__have") + F.row_number().over(Window.partitionBy("query_id").orderBy("wanted", "name", "type")))
    named = named.join(near.select("query_id", "name"), ["query_id", "name"], "left_anti")
    return near.select("query_id", "name", F.col("rank").alias("pos")).unionByName(named.select("query_id", "name", "pos"))


def search(near: DataFrame, wanted: DataFrame, entities: DataFrame, relationships: DataFrame, chunks: DataFrame, config: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Seeds, paths and chunks of a batch of queries: entities by vector or by name, without hubs, what lies two edges around, its chunks."""
    chosen = settled(choose_seeds(find_seeds(near, wanted, entities), entities, relationships, config))
    paths = settled(traverse(chosen, entities, relationships, config))
    return chosen, paths, settled(resolve_chunks(paths, chosen, entities, chunks, config))


def community_info(entities: DataFrame, edges: DataFrame, by_source_only: bool = False) -> DataFrame:
    """(community_id, entity_names, entity_types, relationship_types, size) of assigned entities."""
    own = entities.filter("community_id is not null")
    groups = own.groupBy("community_id").agg(F.sort_array(F.collect_list("name")).alias("entity_names"), F.sort_array(F.collect_set("type")).alias("entity_types"), F.count(F.lit(1)).alias("size"))
    of = own.select("name", "type", "community_id")
    src = edges.join(of, (F.col("src_name") == F.col("name")) & (F.col("src_type") == F.col("type"))).select("community_id", "rel_type")
    dst = edges.join(of, (F.col("dst_name") == F.col("name")) & (F.col("dst_type") == F.col("type"))).select("community_id", "rel_type")
    types = (src if by_source_only else src.unionByName(dst)).groupBy("community_id").agg(F.sort_array(F.collect_set("rel_type")).alias("relationship_types"))
    return groups.join(types, "community_id", "left").withColumn("relationship_types", F.coalesce("relationship_types", F.array().cast("array<string>")))


def triples(edges: DataFrame) -> DataFrame:
    """Distinct (h, r, t) of 'name::type' ends, without self-loops."""
    end = lambda side: F.concat_ws("::", f"{side}_name", f"{side}_type")
    return edges.select(end("src").alias("h"), F.col("rel_type").alias("r"), end("dst").alias("t")).filter("h <> t").distinct()

"""Ingestion: a batch of files through versions, chunks, metadata, graph and vectors, set-based from end to end.

A file that fails carries its error in a column and doesn't stop the others. Steps after chunking that fail as a whole
(graph, vectors) are reported and leave what is saved in place.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.config import DEFAULT, EngineConfig
from quillgraph.functions import text, vectors
from quillgraph.operators import chunking, community, entity_dedup, graph, graph_learning, retrieval, versions
from quillgraph.plans.providers import Providers, retried
from quillgraph.schemas import METADATA
from quillgraph.sources import files
from quillgraph.sources.catalog import Catalog, no_automatic_broadcast, settled, update


def coref(chunks: DataFrame, providers: Providers, config: EngineConfig = DEFAULT) -> DataFrame:
    """Chunks with mentions inside them replaced, by a provider that sees the chunk before; unchanged without one. A chunk without text stays so."""
    if providers.coref is None:
        return chunks
    from pyspark.sql import Window

    resolve, least = providers.coref, config.min_tokens
    before = F.lag("content").over(Window.partitionBy("document_id").orderBy("chunk_index"))
    own = chunks.withColumn("__before", F.coalesce(before, F.lit("")))

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            made = []
            for prev, content, n in zip(*(batch.column(names.index(c)).to_pylist() for c in ("__before", "content", "token_count")), strict=True):
                if content is not None and n >= least:
                    for start, end, mention in sorted(resolve(prev, content), reverse=True):
                        if 0 <= start < end <= len(content) and len(content[start:end].split()) <= 3:
                            content = content[:start] + mention + content[end:]
                made.append(content)
            columns = [pa.array(made, pa.string()) if n == "content" else batch.column(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return own.mapInArrow(run, own.schema).drop("__before")


def enriched(chunks: DataFrame, documents: DataFrame, providers: Providers, now: Column, config: EngineConfig = DEFAULT) -> DataFrame:
    """Chunks with their metadata struct; small ones and those whose enrichment fails have the fixed fields only."""
    work, least = providers.enrich, config.min_tokens

    def run(batches):
        for batch in batches:
            told = []
            for content, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    told.append(json.dumps(retried(work, content, pause=0.0)) if n >= least else None)
                except Exception:  # as documented: empty metadata
                    told.append(json.dumps({"summary": "", "keywords": [], "hypothetical_questions": [], "entities": {"people": [], "organizations": [], "dates": [], "money": []}}))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "told": pa.array(told, pa.string())})

    shape = METADATA.split("chunk_type")[0].removesuffix(",") + ">"
    told = chunks.select("id", "content", "token_count").mapInArrow(run, "id string, told string").select("id", F.from_json("told", shape).alias("m"))
    docs = documents.select(F.col("id").alias("document_id"), "version", F.col("ingested_at").alias("__at"))
    own = chunks.join(told, "id", "left").join(docs, "document_id", "left")
    fixed = [
        text.chunk_type("content", "has_table", "has_code", F.col("token_count")).alias("chunk_type"), text.freshness("__at", now, config).alias("freshness_score"), F.col("document_id"), F.col("section_path"),
        F.col("version"), F.col("content_hash"), F.col("__at").alias("ingested_at"), now.alias("enriched_at"),
    ]
    model = [F.col(f"m.{n}").alias(n) for n in ("summary", "keywords", "hypothetical_questions", "entities")]
    return own.withColumn("metadata", F.struct(*model, *fixed)).drop("m", "version", "__at")


def extracted(chunks: DataFrame, providers: Providers, config: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Entities and relationships of chunks, with ``seq`` for their order; failed chunks give none."""
    work, least = providers.extract, config.min_tokens

    def run(batches):
        for batch in batches:
            told = []
            for content, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                try:
                    told.append(json.dumps(retried(work, content, pause=0.0)) if n >= least else None)
                except Exception:  # a chunk without a usable reply adds nothing
                    told.append(None)
            yield pa.RecordBatch.from_pydict({"document_id": batch.column(0), "chunk_index": batch.column(1), "told": pa.array(told, pa.string())})

    shape = "struct<entities:array<struct<name:string,type:string,confidence:double,properties:map<string,string>>>,relationships:array<struct<source:string,target:string,type:string,confidence:double,properties:map<string,string>>>>"
    told = chunks.select("document_id", "chunk_index", "content", "token_count").mapInArrow(run, "document_id string, chunk_index int, told string")
    told = settled(told.select("document_id", "chunk_index", F.from_json("told", shape).alias("t")))
    none = F.from_json(F.lit("{}"), "map<string,string>")
    shared = [F.col("document_id").alias("source_document_id"), F.col("chunk_index").alias("source_chunk_index"), (F.xxhash64("document_id").bitwiseAND(F.lit(0xFFFFF)) * 10**9 + F.col("chunk_index") * 10**4 + F.col("i")).alias("seq")]

    def parts(name: str, kind: str, *columns):
        rows = told.select("document_id", "chunk_index", F.posexplode(f"t.{name}").alias("i", "r"))
        return rows.select(*shared, *columns, F.coalesce("r.type", F.lit(kind)).alias("type"), F.coalesce("r.confidence", F.lit(1.0)).alias("confidence"), F.coalesce("r.properties", none).alias("properties"))

    return parts("entities", "Unknown", F.col("r.name").alias("name")).filter("name is not null"), parts("relationships", "RELATED_TO", F.col("r.source").alias("source_entity"), F.col("r.target").alias("target_entity"))


@dataclass
class Ingestion:
    """Ingests into a catalog. ``clock`` gives the time as a column, so runs can be repeated."""

    catalog: Catalog
    providers: Providers = field(default_factory=Providers)
    config: EngineConfig = DEFAULT
    clock: Column | None = None
    incremental: bool = True

    @property
    def spark(self) -> SparkSession:
        return self.catalog.spark

    def now(self) -> Column:
        return self.clock if self.clock is not None else F.current_timestamp()

    def ingest_paths(self, paths: list[str], category_id: str | None = None) -> DataFrame:
        rows = files.read_files(self.spark, paths).select(F.regexp_extract("path", r"[^/]+$", 0).alias("path"), "length", "content", F.unix_micros("modificationTime").alias("arrived"))
        return self.ingest(rows, category_id)

    def ingest(self, rows: DataFrame, category_id: str | None = None) -> DataFrame:
        """(filename, id, version, status, error, chunks) for (path, length, content) rows, in order of path.

        Of several files of one name, the versions follow ``arrived`` (a number that rows may have), then the content's hash.
        """
        self.spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        began = time.monotonic()
        rows = rows if "arrived" in rows.columns else rows.withColumn("arrived", F.lit(0).cast("long"))
        parsed = files.parsed(files.validated(rows, self.config), self.providers.parse)
        parsed = settled(parsed.select(F.col("path").alias("filename"), "content_hash", "full_markdown", "page_count", "error", F.struct("arrived", "path", "content_hash").alias("seq")))
        usable = parsed.filter("error is null")
        known, old_chunks = self.catalog.read("documents"), self.catalog.read("chunks")
        before = settled(versions.active(known).select("filename", F.col("id").alias("old_id")))
        after, told = versions.track(known, usable.select("seq", "filename", "content_hash", "full_markdown", "page_count", F.lit(category_id).cast("string").alias("category_id")), self.now())
        after, told = settled(after), settled(told)
        # New documents, and known ones that were never chunked.
        empty = told.filter("not is_new").select("id").distinct().join(old_chunks.select(F.col("document_id").alias("id")), "id", "left_anti")
        work = told.filter("is_new").select("id").unionByName(empty).distinct()
        docs = settled(after.join(work, "id", "left_semi"))
        chunks = settled(chunking.chunk_documents(docs.select(F.col("id").alias("document_id"), F.col("full_markdown").alias("markdown")), self.config))
        chunks = settled(enriched(coref(chunks, self.providers, self.config), docs, self.providers, self.now(), self.config))
        was = known.select("id", F.col("status").alias("__was"))
        self.catalog.upsert("documents", after.join(was, "id", "left").filter("__was is null or __was <> status"))
        problems = []
        try:
            self._graph(chunks, docs, before, old_chunks)
        except Exception as problem:  # the graph step must not lose the chunks
            problems.append(f"graph: {problem}")
        gone = settled(old_chunks.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi").select("id"))
        self.catalog.merge("chunks", chunks, gone)
        gone = gone.withColumnRenamed("id", "chunk_id")
        self._index(chunks, gone)
        try:
            self.embed(chunks, gone)
        except Exception as problem:  # vectors can be made later
            problems.append(f"embed: {problem}")
        counts = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("chunks"))
        result = parsed.select("seq", "filename", "error").join(told.select("seq", "id", "version", "is_new"), "seq", "left").join(work.withColumn("__work", F.lit(True)), "id", "left").join(counts, "id", "left")
        status = F.when(F.col("error").isNotNull(), "failed").when(F.coalesce("__work", F.lit(False)), "completed").otherwise("skipped")
        result = settled(result.select("filename", "id", "version", status.alias("status"), "error", F.coalesce("chunks", F.lit(0)).alias("chunks")).orderBy("filename"))
        ms = round((time.monotonic() - began) * 1000, 1)
        self.log(result, ms, "; ".join(problems) or None)
        return result

    def _graph(self, chunks: DataFrame, docs: DataFrame, before: DataFrame, old_chunks: DataFrame) -> None:
        entities, edges = self.catalog.read("entities"), self.catalog.read("relationships")
        work = chunks
        if self.incremental:
            old = docs.select("id", "filename").join(before, "filename")
            base = old_chunks.join(old.select(F.col("old_id").alias("document_id"), F.col("id").alias("__new")), "document_id").select(F.col("__new").alias("document_id"), "chunk_index", "content_hash", F.col("document_id").alias("__old"))
            changed = settled(chunking.changed_chunks(chunks, base))
            work = chunks.join(changed, ["document_id", "chunk_index"], "left_semi")
            stale = settled(base.join(changed.filter("not is_new"), ["document_id", "chunk_index"]).select(F.col("__old").alias("doc"), "chunk_index").distinct())
            hit = entities.select("name", "type", F.explode("source_document_ids").alias("doc"), F.col("source_chunk_index").alias("chunk_index")).join(stale, ["doc", "chunk_index"], "left_semi").select("name", "type").distinct()
            hit = settled(hit)
            entities = update(entities, hit.withColumn("status", F.lit("deprecated")), ("name", "type"), ("status",))
        found, relations = extracted(work, self.providers, self.config)
        merged = settled(entity_dedup.dedup_enhanced(found, lambda c: self.providers.embed(c, self.config.sage_dims[0]), self.config))
        relations = graph.dedup_relationships(relations, merged)
        new = settled(merged.select("name", "type", "source_document_id", "source_chunk_index", "confidence", "properties").dropDuplicates(["name", "type"]))
        touched = new.select("name", "type")
        touched = touched.unionByName(hit).distinct() if self.incremental else touched
        self.catalog.upsert("entities", graph.merge_entities(entities.join(touched, ["name", "type"], "left_semi").select(*entities.columns), new))
        # Only edges that are found again are read and written.
        made = settled(graph.merge_relationships(edges.limit(0), relations.dropDuplicates(["source_entity", "target_entity", "type"]), self.catalog.read("entities")))
        known = edges.join(made.select("edge_id"), "edge_id", "left_semi").select("edge_id", F.col("confidence").alias("__known"))
        self.catalog.upsert("relationships", made.join(known, "edge_id", "left").withColumn("confidence", F.greatest("confidence", "__known")))

    def _index(self, chunks: DataFrame, gone: DataFrame) -> None:
        m = F.col("metadata")
        own = chunks.select(F.col("id").alias("chunk_id"), text.search_text("content", m["summary"], m["hypothetical_questions"], m["keywords"]).alias("content"))
        self.catalog.merge("postings", retrieval.postings(own, english=True), gone)

    def embed(self, chunks: DataFrame, gone: DataFrame | None = None) -> None:
        m = F.col("metadata")
        body = text.chunk_embedding_text("content", "section_path", m["summary"], m["keywords"], m["hypothetical_questions"])
        rows = chunks.select(F.col("id").alias("chunk_id"), self.providers.embed(body, self.config.text_dim).cast("array<float>").alias("embedding"))
        hybrid = vectors.query_hybrid("embedding", self.config.text_dim, self.config.part_dim).cast("array<float>")
        self.catalog.merge("chunk_embeddings", rows.withColumn("hybrid", hybrid), gone)

    def log(self, result: DataFrame, ms: float, problem: str | None) -> None:
        rows = result.select(F.coalesce("id", F.sha2("filename", 256)).alias("id"), F.unix_micros(self.now()).alias("seq"), "filename", "status", F.when(F.col("status") == "failed", "parse").otherwise("save").alias("step"), F.coalesce("error", F.lit(problem)).alias("error"), F.lit(1).alias("attempt"), self.now().alias("at"), F.map_filter(F.create_map(F.lit("total"), F.lit(ms)), lambda _, v: v > 0).alias("timings"))
        self.catalog.append("ingestion_logs", rows)

    def after_batch(self) -> dict[str, str]:
        """Communities, their vectors, graph vectors and chunk vectors; each step reports its own failure."""
        told = {}
        with no_automatic_broadcast(self.spark):
            for name in ("communities", "community_vectors", "graph_vectors", "hybrid_vectors"):
                try:
                    told[name] = getattr(self, name)()
                except Exception as problem:  # later steps may still work
                    told[name] = f"skipped: {problem}"
        return told

    def communities(self) -> str:
        entities = self.catalog.read("entities")
        edges = graph.active_edges(entities, self.catalog.read("relationships"))
        nodes = entities.filter("status = 'active'").select(F.concat_ws("::", "name", "type").alias("node"))
        found = community.detect(community.undirected(edges), nodes, self.config)
        placed = update(entities, entities.filter("status = 'active'").join(found, F.concat_ws("::", "name", "type") == F.col("node")).select("name", "type", found["community_id"].alias("__c")).withColumnRenamed("__c", "community_id"), ("name", "type"), ("community_id",))
        placed = settled(placed)
        self.catalog.write("entities", placed)
        info = settled(graph.community_info(placed.filter("status = 'active'"), edges))
        write, least = self.providers.summarise_community, self.config.community_min_size

        def run(batches):
            for batch in batches:
                rows = batch.to_pylist()
                yield pa.RecordBatch.from_pydict({"community_id": pa.array([r["community_id"] for r in rows], pa.int32()), "summary": pa.array([write(r["entity_names"], r["relationship_types"]) if r["size"] >= least else None for r in rows], pa.string())})

        told = info.select("community_id", "entity_names", "relationship_types", "size").mapInArrow(run, "community_id int, summary string")
        self.catalog.write("communities", info.join(told, "community_id").withColumn("entity_count", F.col("size").cast("int")))
        return "done"

    def community_vectors(self) -> str:
        own = self.catalog.read("communities").filter("summary is not null")
        body = text.community_embedding_text("entity_names", "entity_types", "relationship_types", "summary")
        # Whatever isn't among the current communities goes, unless there are none.
        if own.limit(1).count():
            self.catalog.write("community_embeddings", own.select("community_id", self.providers.embed(body, self.config.text_dim).cast("array<float>").alias("embedding")))
        return "done"

    def graph_vectors(self, retrain: bool = True) -> str:
        entities = self.catalog.read("entities").filter("status = 'active'")
        edges = graph.active_edges(self.catalog.read("entities"), self.catalog.read("relationships"))
        node = F.concat_ws("::", "name", "type")
        label = F.concat("name", F.lit(" ("), F.col("type"), F.lit(")"))
        nodes = settled(entities.select("name", "type", node.alias("node"), self.providers.embed(label, self.config.sage_dims[0]).alias("x")))
        stored = None if retrain else graph_learning.load_params(self.catalog.read("model_params"), "sage")
        structural, params = graph_learning.sage(nodes.select("node", "x"), community.undirected(edges), self.config, stored)
        self.catalog.upsert("model_params", graph_learning.params_table(self.spark, "sage", params))
        translated, relations = graph_learning.transe(graph.triples(edges), self.config.part_dim, self.config)
        rows = nodes.join(structural.withColumnRenamed("embedding", "structural"), "node", "left").join(translated.withColumnRenamed("embedding", "transe"), "node", "left")
        self.catalog.upsert("entity_embeddings", rows.select("name", "type", "structural", F.col("x").alias("text"), "transe"))
        self.catalog.upsert("relation_embeddings", relations)
        return "done"

    def hybrid_vectors(self) -> str:
        """Chunk vectors with the means of their entities' vectors; chunks without entities keep zeros there."""
        entities = self.catalog.read("entities").filter("status = 'active' and source_chunk_index is not null")
        at = entities.select("name", "type", F.get("source_document_ids", F.lit(0)).alias("document_id"), F.col("source_chunk_index").alias("chunk_index"))
        of_chunk = at.join(self.catalog.read("entity_embeddings"), ["name", "type"]).groupBy("document_id", "chunk_index").agg(F.collect_list(F.col("structural").cast("array<double>")).alias("s"), F.collect_list(F.col("transe").cast("array<double>")).alias("t"))
        chunks = self.catalog.read("chunks").select(F.col("id").alias("chunk_id"), "document_id", "chunk_index").join(of_chunk, ["document_id", "chunk_index"], "left")
        current = self.catalog.read("chunk_embeddings")
        made = current.drop("hybrid").join(chunks, "chunk_id").select("chunk_id", vectors.hybrid("embedding", "s", "t", self.config.text_dim, self.config.part_dim).cast("array<float>").alias("hybrid"))
        self.catalog.upsert("chunk_embeddings", current.drop("hybrid").join(made, "chunk_id"))
        return "done"

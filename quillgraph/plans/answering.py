"""Answering: plan, vector and graph retrieval, conflicts, calculation, summary, and another pass where coverage is poor.

The relational work of a pass is one lineage; the driver decides only between passes.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.config import DEFAULT, EngineConfig
from quillgraph.functions import decisions, vectors
from quillgraph.operators import assembly, graph, retrieval
from quillgraph.plans.providers import Providers, retried
from quillgraph.sources.catalog import Catalog, settled


@dataclass
class Answer:
    query: str
    answer: str = ""
    query_type: str = "SIMPLE"
    chunks: list[dict] = field(default_factory=list)
    paths: list[dict] = field(default_factory=list)
    conflicts: list[dict] = field(default_factory=list)
    calculation: str | None = None
    passes: int = 0
    cached: bool = False
    error: str | None = None
    timings: dict[str, float] = field(default_factory=dict)


@dataclass
class Engine:
    catalog: Catalog
    providers: Providers = field(default_factory=Providers)
    config: EngineConfig = DEFAULT
    clock: Column | None = None

    def now(self) -> Column:
        return self.clock if self.clock is not None else F.current_timestamp()

    def _vectors(self, name: str, rows: list[tuple[str, list[float]]]) -> DataFrame:
        return self.catalog.spark.createDataFrame(rows, f"{name} string, vec array<double>")

    def scoped(self, filters: dict, categories: list[str] | None) -> DataFrame:
        docs = self.catalog.read("documents").select(F.col("id").alias("document_id"), "filename", "version", "status", "category_id", "ingested_at")
        chunks = self.catalog.read("chunks").select(F.col("id").alias("chunk_id"), "document_id", "chunk_index", "content", "section_path", F.col("metadata.chunk_type").alias("chunk_type"), "has_table")
        return retrieval.scope(chunks.join(docs, "document_id"), filters.get("document_id"), filters.get("section_path"), filters.get("filename"), categories, self.config.excluded_types)

    def plan(self, query: str) -> dict:
        """Type, activated steps, phrasings and filters of a query."""
        said: dict = {}
        if self.providers.classify is not None:
            try:
                said = retried(self.providers.classify, query) or {}
            except Exception:  # without a model the patterns decide
                said = {}
        row = self.catalog.spark.createDataFrame([(query, said.get("query_type"))], "q string, t string").select(decisions.execution_plan("q", "t").alias("p")).first()["p"]
        return row.asDict() | {"queries": said.get("expanded_queries") or [query], "filters": said.get("metadata_filters") or {}}

    def vector_rows(self, query: str, plan: dict, scope: DataFrame) -> DataFrame:
        c = self.config
        phrasings = plan["queries"]
        passage = self.providers.hyde(query) if self.providers.hyde and plan["query_type"] != "SIMPLE" else None
        texts = [passage if passage and q == query else q for q in phrasings]
        spark = self.catalog.spark
        asked = self._vectors("query_id", [(str(i), self.providers.embed_query(t, c.text_dim)) for i, t in enumerate(texts)]).select("query_id", vectors.query_hybrid("vec", c.text_dim, c.part_dim).alias("vec"))
        words = spark.createDataFrame([(str(i), q) for i, q in enumerate(phrasings)], "query_id string, text string")
        index = self.catalog.read("chunk_embeddings").join(scope.select("chunk_id"), "chunk_id", "left_semi")
        postings = self.catalog.read("postings").join(scope.select("chunk_id"), "chunk_id", "left_semi")
        by_vector = retrieval.nearest(index, asked, c.vector_top_k, "chunk_id", "hybrid")
        matched = retrieval.match_all(postings, retrieval.query_lexemes(words, english=True))
        by_text = retrieval.ranked(matched.withColumn("score", retrieval.density()), c.lexical_top_k)
        fused = retrieval.reciprocal_rank_fusion([by_vector, by_text], c.fused_top_k, c.rrf_k)
        every = fused.withColumn("seq", F.col("query_id").cast("int") * 1000 + F.col("rank")).withColumn("query_id", F.lit("q"))
        return self._reranked(retrieval.dedup_best(every), scope, query).withColumn("source", F.lit("fused"))

    def _reranked(self, rows: DataFrame, scope: DataFrame, query: str) -> DataFrame:
        from pyspark.sql import Window

        ordered = rows.join(scope, "chunk_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "seq")))
        relevance = self.providers.relevance(F.lit(query), F.col("content")) if self.providers.relevance else None
        return retrieval.rerank(ordered, relevance, self.now(), self.config)

    def graph_rows(self, query: str, scope: DataFrame) -> tuple[DataFrame | None, list[dict]]:
        c = self.config
        entities, edges = self.catalog.read("entities"), self.catalog.read("relationships")
        index = self.catalog.read("entity_embeddings").join(entities.filter("status = 'active'").select("name", "type"), ["name", "type"], "left_semi").filter("text is not null").groupBy("name").agg(F.min_by("text", "type").alias("text"))
        asked = self._vectors("query_id", [("q", self.providers.embed_query(query, c.sage_dims[0]))])
        near = settled(retrieval.nearest(index, asked, c.seed_top_k, "name", "text", c.seed_cosine).select("query_id", "name", "rank"))
        names = [] if near.count() >= 2 else [e["name"] for e in self.providers.extract(query).get("entities", [])]
        wanted = self.catalog.spark.createDataFrame([("q", n) for n in names], "query_id string, name string")
        chosen, paths, found = graph.search(near, wanted, entities, edges, scope, c)
        if chosen.isEmpty():
            return None, []
        ids = [r["chunk_id"] for r in found.orderBy("rank").collect()]  # graph_top_k at most
        told = [{"entities": [r["seed_name"], r["name"]], "relationships": r["rel_types"], "confidence": r["hop_weight"], "source_chunks": ids} for r in paths.orderBy(F.desc("hop_weight"), "seed_name", "name").collect()]
        own = self._reranked(found.select("query_id", "chunk_id", "score", F.col("rank").alias("seq")), scope, query)
        return own.withColumn("source", F.lit("graph")), told

    def calculate(self, query: str, contents: list[str]) -> str | None:
        operation, numbers = self.providers.numbers(query, contents)
        row = self.catalog.spark.createDataFrame([(operation, numbers)], "o string, n array<double>").select(decisions.calculate("o", "n").alias("r")).first()
        return None if row["r"] is None else f"Calculation ({operation}): {row['r']} (from numbers: {numbers})"

    def query(self, query: str, history: list[dict] | None = None, categories: list[str] | None = None, prompt: str | None = None, scope_key: str | None = None) -> Answer:
        """Never raises: what goes wrong is in ``error``."""
        began = time.monotonic()
        out = Answer(query)
        try:
            small = self.providers.embed_query(query, 256)
            hit = assembly.cache_lookup(self.catalog.read("semantic_cache"), self._vectors("query_id", [("q", small)]), self.now(), self.config, scope_key).first()
            if hit:
                stored = json.loads(self.catalog.read("semantic_cache").filter(F.col("id") == hit["id"]).first()["result_json"])
                out.answer, out.query_type, out.chunks, out.cached = stored["answer"], stored["query_type"], [{"chunk_id": i} for i in stored["chunk_ids"]], True
            else:
                self._passes(out, history or [], categories, prompt)
                self._remember(out, small, scope_key)
        except Exception as problem:
            out.error = str(problem)
            out.answer = out.answer or "An error occurred while answering."
        out.timings["total"] = round((time.monotonic() - began) * 1000, 1)
        self._log(out)
        return out

    def _passes(self, out: Answer, history: list[dict], categories, prompt) -> None:
        c, spark = self.config, self.catalog.spark
        plan = self.plan(out.query)
        out.query_type = plan["query_type"]
        gathered: list[dict] = []
        while True:
            scope = settled(self.scoped(plan["filters"], categories))
            parts = [self.vector_rows(out.query, plan, scope)]
            if out.passes == 0 and plan["activate_graph"]:
                rows, out.paths = self.graph_rows(out.query, scope)
                parts += [rows] if rows is not None else []
            columns = ["chunk_id", "document_id", "content", "score", "section_path", "chunk_type", "filename", "version", "ingested_at", "source"]
            for p in parts:
                gathered += [r.asDict() for r in p.orderBy("rank").select(*columns).collect()]  # rerank_top at most
            out.passes += 1
            if self.providers.conflicts is not None:
                self._conflicts(out, gathered)
            first: dict[str, dict] = {}
            for r in gathered:
                first.setdefault(r["chunk_id"], r)
            kept = list(first.values())[: c.context_chunks]
            if plan["activate_calculator"]:
                out.calculation = self.calculate(out.query, [r["content"] for r in kept])
            context = ""
            if kept:
                own = spark.createDataFrame([("q", i, r["chunk_id"], r["content"], float(r["score"]), r["section_path"], r["chunk_type"], r["filename"]) for i, r in enumerate(kept)], "query_id string, seq int, chunk_id string, content string, score double, section_path string, chunk_type string, filename string")
                context = assembly.context(own, c).first()["context"]
            out.chunks = kept
            out.answer = retried(self.providers.answer, out.query, context, out.calculation, self.trimmed(history), prompt)
            row = spark.createDataFrame([(out.answer, len(gathered), out.query_type, out.passes)], "a string, n int, t string, p int")
            if not row.select(decisions.needs_another_pass("a", "n", "t", "p", c).alias("x")).first()["x"]:
                return
            plan["filters"] = {}

    def trimmed(self, history: list[dict]) -> list[dict]:
        if not history:
            return []
        rows = self.catalog.spark.createDataFrame([("c", i, i, m["role"], m.get("content", "")) for i, m in enumerate(history)], "conversation_id string, id int, created_at int, role string, content string")
        return [{"role": r["role"], "content": r["content"]} for r in assembly.trim_history(rows, self.config).orderBy("id").collect()]

    def _conflicts(self, out: Answer, gathered: list[dict]) -> None:
        first = gathered[: self.config.context_chunks]
        pairs = self.providers.conflicts(out.query, [{**r, "content": r["content"][:600]} for r in first])
        if not pairs or not first:
            return
        spark = self.catalog.spark
        rows = spark.createDataFrame([("q", i, r["chunk_id"], r["version"], str(r["ingested_at"]), False, float(r["score"])) for i, r in enumerate(first)], "query_id string, seq int, chunk_id string, version int, ingested_at string, has_table boolean, score double")
        asked = spark.createDataFrame([("q", a, b) for a, b in pairs], "query_id string, a_id string, b_id string")
        out.conflicts = [r.asDict() for r in assembly.resolve_conflicts(asked, rows).collect()]

    def _remember(self, out: Answer, vec: list[float], scope_key: str | None) -> None:
        row = [(out.query, vec, out.answer, len(out.chunks), out.error, False, {"answer": out.answer, "query_type": out.query_type, "chunk_ids": [r["chunk_id"] for r in out.chunks]})]
        rows = self.catalog.spark.createDataFrame(row, "query string, vec array<double>, answer string, n_chunks int, error string, skipped boolean, result struct<answer:string,query_type:string,chunk_ids:array<string>>")
        self.catalog.upsert("semantic_cache", assembly.cache_rows(rows, self.now(), self.config).withColumn("scope_key", F.lit(scope_key).cast("string")))

    def _log(self, out: Answer) -> None:
        rows = self.catalog.spark.createDataFrame([(out.query, out.query_type, len(out.chunks), out.cached, out.timings["total"])], "query string, query_type string, chunks int, cached boolean, total_ms double")
        self.catalog.append("query_logs", rows.withColumn("created_at", self.now()).withColumn("id", F.sha2(F.concat_ws("|", "query", F.col("created_at").cast("string")), 256)))

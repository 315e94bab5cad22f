"""Answers to a table of questions: the steps of ``Engine.query`` as one set of joins and Arrow functions, without a driver loop.

Differences from asking one by one: questions of a batch don't see each other's cached answers, a classifier's metadata filters and
conflicts between chunks are left to single questions, and there is one pass. A second pass does no more than drop those
filters; ``covered`` says whether a single question would have asked for it.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import decisions, vectors
from quillgraph.operators import assembly, graph, retrieval
from quillgraph.plans.answering import Engine
from quillgraph.plans.providers import retried
from quillgraph.sources.catalog import settled

#: Ranks of one list are below this, so lists can be put one after another.
_LIST = 1000
_RESULT = "struct<answer:string,query_type:string,chunk_ids:array<string>>"


def _told(rows: DataFrame, work, inputs: list[str], shape: str) -> DataFrame:
    """(query_id, told, error): what a provider says to each row; ``told`` is null where it failed."""

    def run(batches):
        for batch in batches:
            told, errors = [], []
            for row in zip(*(batch.column(i + 1).to_pylist() for i in range(len(inputs))), strict=True):
                try:
                    told.append(json.dumps({"v": retried(work, *row)}))
                    errors.append(None)
                except Exception as problem:
                    told.append(None)
                    errors.append(str(problem))
            yield pa.RecordBatch.from_pydict({"query_id": batch.column(0), "told": pa.array(told, pa.string()), "error": pa.array(errors, pa.string())})

    made = rows.select("query_id", *inputs).mapInArrow(run, "query_id string, told string, error string")
    return made.select("query_id", F.from_json("told", f"struct<v:{shape}>")["v"].alias("told"), "error")


def _planned(engine: Engine, asked: DataFrame) -> DataFrame:
    """Questions with type, steps and phrasings; patterns decide where there is no classifier or it fails."""
    if engine.providers.classify is None:
        said = asked.withColumn("said", F.lit(None).cast("string")).withColumn("phrases", F.array("query"))
    else:
        work = engine.providers.classify
        told = _told(asked, lambda q: {k: (work(q) or {}).get(k) for k in ("query_type", "expanded_queries")}, ["query"], "struct<query_type:string,expanded_queries:array<string>>")
        said = asked.join(told.select("query_id", F.col("told.query_type").alias("said"), F.col("told.expanded_queries").alias("phrases")), "query_id")
        said = said.withColumn("phrases", F.when(F.size("phrases") > 0, F.col("phrases")).otherwise(F.array("query")))
    return said.withColumn("plan", decisions.execution_plan("query", "said")).select(*asked.columns, "phrases", "plan.query_type", "plan.activate_graph", "plan.activate_calculator")


def _reranked(engine: Engine, rows: DataFrame, scope: DataFrame, planned: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seq")
    own = rows.join(scope, "chunk_id").withColumn("rank", F.row_number().over(order))
    relevance = engine.providers.relevance
    if relevance is not None:
        own = own.join(planned.select("query_id", "query"), "query_id")
    return retrieval.rerank(own, relevance and relevance(F.col("query"), F.col("content")), engine.now(), engine.config)


def _fused(engine: Engine, planned: DataFrame, scope: DataFrame) -> DataFrame:
    """Vector and full-text rows of all phrasings of all questions."""
    c, p = engine.config, engine.providers
    phrases = planned.select("query_id", "query", "query_type", F.posexplode("phrases").alias("i", "text"))
    if p.hyde is not None:
        passage = _told(planned.filter("query_type <> 'SIMPLE'"), p.hyde, ["query"], "string")
        phrases = phrases.join(passage.select("query_id", "told"), "query_id", "left").withColumn("vector_text", F.when(F.col("text") == F.col("query"), F.coalesce("told", "text")).otherwise(F.col("text")))
    else:
        phrases = phrases.withColumn("vector_text", F.col("text"))
    own = phrases.select(F.concat_ws(":", "i", "query_id").alias("query_id"), "text", "vector_text")
    asked = own.select("query_id", vectors.query_hybrid(p.embed("vector_text", c.text_dim), c.text_dim, c.part_dim).alias("vec"))
    ids = scope.select("chunk_id")
    by_vector = retrieval.nearest(engine.catalog.read("chunk_embeddings").join(ids, "chunk_id", "left_semi"), settled(asked), c.vector_top_k, "chunk_id", "hybrid")
    matched = retrieval.match_all(engine.catalog.read("postings").join(ids, "chunk_id", "left_semi"), retrieval.query_lexemes(own, english=True))
    by_text = retrieval.ranked(matched.withColumn("score", retrieval.density()), c.lexical_top_k)
    fused = retrieval.reciprocal_rank_fusion([by_vector, by_text], c.fused_top_k, c.rrf_k)
    every = fused.withColumn("seq", F.substring_index("query_id", ":", 1).cast("int") * _LIST + F.col("rank")).withColumn("query_id", F.regexp_replace("query_id", "^[0-9]+:", ""))
    return _reranked(engine, retrieval.dedup_best(every), scope, planned)


def _by_graph(engine: Engine, planned: DataFrame, scope: DataFrame) -> DataFrame:
    """Rows that the graph leads to, for questions whose plan asks for them."""
    c, p, catalog = engine.config, engine.providers, engine.catalog
    wanting = planned.filter("activate_graph")
    entities, edges = catalog.read("entities"), catalog.read("relationships")
    live = entities.filter("status = 'active'").select("name", "type")
    index = catalog.read("entity_embeddings").join(live, ["name", "type"], "left_semi").filter("text is not null").groupBy("name").agg(F.min_by("text", "type").alias("text"))
    asked = settled(wanting.select("query_id", p.embed("query", c.sage_dims[0]).alias("vec")))
    near = settled(retrieval.nearest(index, asked, c.seed_top_k, "name", "text", c.seed_cosine).select("query_id", "name", "rank"))
    enough = near.groupBy("query_id").count().filter("count >= 2")
    work = p.extract
    names = _told(wanting.join(enough, "query_id", "left_anti"), lambda q: [e["name"] for e in work(q).get("entities", [])], ["query"], "array<string>")
    _, _, found = graph.search(near, settled(names.select("query_id", F.explode("told").alias("name"))), entities, edges, scope, c)
    return _reranked(engine, found.select("query_id", "chunk_id", "score", F.col("rank").alias("seq")), scope, planned)


def _calculated(engine: Engine, planned: DataFrame, kept: DataFrame) -> DataFrame:
    """(query_id, operation, numbers, result) of questions that ask for arithmetic."""
    contents = kept.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda s: s["content"]).alias("contents"))
    own = planned.filter("activate_calculator").join(contents, "query_id", "left").withColumn("contents", F.coalesce("contents", F.array().cast("array<string>")))
    work = engine.providers.numbers
    told = _told(own, lambda q, texts: dict(zip(("operation", "numbers"), work(q, texts))), ["query", "contents"], "struct<operation:string,numbers:array<double>>")
    return told.select("query_id", "told.operation", "told.numbers").withColumn("result", decisions.calculate("operation", "numbers"))


def answer_all(engine: Engine, questions: DataFrame, categories: list[str] | None = None, prompt: str | None = None, scope_key: str | None = None) -> DataFrame:
    """(query_id, query, query_type, chunk_ids, answer, cached, covered, error) for each row of (query_id, query).

    A null question counts as empty; ``query_id`` is unique and comes back as text. Answers are cached and logged like those of single questions.
    """
    c, p, catalog = engine.config, engine.providers, engine.catalog
    asked = questions.select(F.col("query_id").cast("string").alias("query_id"), F.coalesce("query", F.lit("")).alias("query"))
    asked = settled(asked.withColumn("small", p.embed("query", 256)))
    cache = catalog.read("semantic_cache")
    hits = assembly.cache_lookup(cache, asked.select("query_id", F.col("small").alias("vec")), engine.now(), c, scope_key)
    stored = settled(hits.join(cache.select("id", "result_json"), "id").select("query_id", F.from_json("result_json", _RESULT).alias("r")))
    planned = settled(_planned(engine, asked.join(stored, "query_id", "left_anti")))

    scope = settled(engine.scoped({}, categories))
    columns = ["query_id", "chunk_id", "content", "score", "section_path", "chunk_type", "filename"]
    gathered = _fused(engine, planned, scope).select(*columns, F.col("rank").alias("seq"))
    if not planned.filter("activate_graph").isEmpty():
        gathered = gathered.unionByName(_by_graph(engine, planned, scope).select(*columns, (F.col("rank") + _LIST).alias("seq")))
    gathered = settled(gathered)
    best = Window.partitionBy("query_id").orderBy("seq")
    kept = retrieval.dedup_first(gathered).withColumn("seq", F.row_number().over(best)).filter(F.col("seq") <= c.context_chunks)
    kept = settled(kept)

    ids = kept.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk_id"))), lambda s: s["chunk_id"]).alias("chunk_ids"))
    ready = planned.join(assembly.context(kept, c), "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    ready = ready.join(_calculated(engine, planned, kept), "query_id", "left")
    work = p.answer

    def say(query, context, operation, numbers, result):
        return work(query, context, None if result is None else f"Calculation ({operation}): {result} (from numbers: {numbers})", [], prompt)

    told = _told(ready, say, ["query", "context", "operation", "numbers", "result"], "string")
    done = planned.join(told, "query_id").join(ids, "query_id", "left").join(gathered.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left")
    answer: Column = F.coalesce("told", F.lit("An error occurred while answering."))
    done = done.select("query_id", "query", "query_type", F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"), answer.alias("answer"), F.lit(False).alias("cached"), F.coalesce("n", F.lit(0)).alias("n"), "error", "small")
    done = settled(done.withColumn("covered", ~decisions.needs_another_pass("answer", "n", "query_type", F.lit(1), c)))
    _remember(engine, done, scope_key)
    known = asked.join(stored, "query_id").select("query_id", "query", "r.query_type", "r.chunk_ids", "r.answer", F.lit(True).alias("cached"), F.lit(True).alias("covered"), F.lit(None).cast("string").alias("error"))
    every = settled(done.select(*known.columns).unionByName(known))
    rows = every.select("query", "query_type", F.size("chunk_ids").alias("chunks"), "cached", F.lit(None).cast("double").alias("total_ms"), engine.now().alias("created_at"), F.sha2(F.concat_ws("|", "query_id", "query", engine.now().cast("string")), 256).alias("id"))
    catalog.append("query_logs", rows)
    return every


def _remember(engine: Engine, done: DataFrame, scope_key: str | None) -> None:
    result = F.struct("answer", "query_type", "chunk_ids")
    rows = done.select("query", F.col("small").alias("vec"), "answer", F.size("chunk_ids").alias("n_chunks"), "error", F.lit(False).alias("skipped"), result.alias("result"))
    kept = assembly.cache_rows(rows, engine.now(), engine.config).dropDuplicates(["id"])
    engine.catalog.upsert("semantic_cache", kept.withColumn("scope_key", F.lit(scope_key).cast("string")))

"""From retrieved rows to an answer: context, history, cache and conflicts, for batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.config import DEFAULT, EngineConfig
from quillgraph.functions import decisions
from quillgraph.operators import retrieval


def ordered_context(rows: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Rows within the context's budget of characters, definitions first and then by score, with ``entry`` and ``pos``.

    Entries are joined by two characters; the first that doesn't fit ends the context.
    """
    first = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("chunk_type", F.lit("")) == "DEFINITION"), F.desc("score"), "seq")
    entry = F.concat(F.lit("["), F.substring("chunk_id", 1, 12), F.lit("] (file: "), F.col("filename"), F.lit(", section: "), F.col("section_path"), F.lit(")\n"), F.col("content"))
    size = lambda length: F.sum(length + 2).over(first.rowsBetween(Window.unboundedPreceding, 0)) - 2
    # Where each query's context ends is found from lengths alone, so texts that don't fit are never brought together; a short row for each query goes out.
    score = F.col("score").cast("double")
    key = F.struct(F.coalesce("chunk_type", F.lit("")) != "DEFINITION", score.isNull(), ~F.isnan(score), -score, F.col("seq"))
    ends = rows.select("query_id", "chunk_type", "score", "seq", F.length(entry).alias("__length")).withColumn("__used", size(F.col("__length")))
    ends = ends.filter(F.col("__used") <= 4 * config.context_tokens).groupBy(F.col("query_id").alias("__query")).agg(F.max(key).alias("__end"))
    near = rows.join(F.broadcast(ends), F.col("query_id").eqNullSafe(F.col("__query"))).filter(key <= F.col("__end")).drop("__query", "__end")
    own = near.withColumn("entry", entry).withColumn("pos", F.row_number().over(first))
    return own.withColumn("__used", size(F.length("entry"))).filter(F.col("__used") <= 4 * config.context_tokens).drop("__used")


def context(rows: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(query_id, context)."""
    kept = ordered_context(rows, config).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry"))), lambda s: s["entry"]), "\n\n").alias("context"))
    return rows.select("query_id").distinct().join(kept, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))


def trim_history(messages: DataFrame, config: EngineConfig = DEFAULT, conversation: str = "conversation_id", order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """The messages from the earliest user message on from which at most N remain and their text fits."""
    back = Window.partitionBy(conversation).orderBy(*[F.desc(c) for c in order])
    own = messages.withColumn("__back", F.row_number().over(back)).withColumn("__size", F.sum(F.length(F.coalesce("content", F.lit("")))).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    fits = (F.col("role") == "user") & (F.col("__back") <= config.history_messages) & (F.col("__size") <= config.history_chars)
    start = F.max(F.when(fits, F.col("__back"))).over(Window.partitionBy(conversation))
    return own.withColumn("__start", start).filter(F.col("__back") <= F.col("__start")).drop("__back", "__size", "__start")


def cache_lookup(cache: DataFrame, queries: DataFrame, now: Column, config: EngineConfig = DEFAULT, scope_key: str | None = None) -> DataFrame:
    """(query_id, id, score): the nearest live entry above the threshold."""
    live = cache.filter(F.col("expires_at") > now)
    if scope_key is not None:
        live = live.filter(F.col("scope_key") == scope_key)
    return retrieval.nearest(live, queries, 1, "id", "embedding", config.cache_cosine).drop("rank")


def cache_rows(results: DataFrame, now: Column, config: EngineConfig = DEFAULT) -> DataFrame:
    """Cache rows of results that are worth keeping: (query, vec, answer, n_chunks, error, skipped, result struct)."""
    kept = results.filter(decisions.cacheable("answer", "n_chunks", "error", "skipped"))
    return kept.select(F.sha2(F.concat_ws("|", "query", now.cast("string")), 256).alias("id"), "query", F.col("vec").cast("array<float>").alias("embedding"), F.to_json("result").alias("result_json"), (now + F.make_dt_interval(hours=F.lit(config.cache_hours))).alias("expires_at"))


def resolve_conflicts(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, a_id, b_id, winner_id, rule) for pairs of ids, which may be the first 12 characters only.

    Of chunks that share a prefix the last by ``seq`` counts.
    """
    named = rows.select("query_id", F.explode(F.array_distinct(F.array(F.col("chunk_id"), F.substring("chunk_id", 1, 12)))).alias("name"), F.struct("chunk_id", "version", "ingested_at", "has_table", "score", "seq").alias("c"))
    last = named.groupBy("query_id", "name").agg(F.max_by("c", "c.seq").alias("c"))
    a = last.select("query_id", F.col("name").alias("a_id"), F.col("c").alias("a"))
    b = last.select("query_id", F.col("name").alias("b_id"), F.col("c").alias("b"))
    both = pairs.join(a, ["query_id", "a_id"]).join(b, ["query_id", "b_id"]).filter("a.chunk_id <> b.chunk_id").withColumn("w", decisions.conflict_winner("a", "b"))
    return both.select("query_id", F.col("a.chunk_id").alias("a_id"), F.col("b.chunk_id").alias("b_id"), F.when(F.col("w.winner") == "a", F.col("a.chunk_id")).otherwise(F.col("b.chunk_id")).alias("winner_id"), F.col("w.rule").alias("rule"))


def has_digits(rows: DataFrame, most: int = 10, order: tuple = ("seq",)) -> DataFrame:
    """(query_id, digits): whether one of the first chunks has a digit; texts are looked at where they are."""
    own = rows.withColumn("digits", F.col("content").rlike(r"\p{Nd}")).drop("content")
    first = own.withColumn("__turn", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("__turn") <= most)
    return first.groupBy("query_id").agg(F.max("digits").alias("digits"))

"""Listings of the catalog's tables, one statement each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def documents(docs: DataFrame, chunks: DataFrame, categories: DataFrame) -> DataFrame:
    """Active documents with their number of chunks and category name, newest first."""
    count = chunks.groupBy("document_id").agg(F.count("id").alias("chunk_count"))
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    own = docs.filter("status = 'active'").join(count, F.col("id") == F.col("document_id"), "left").drop("document_id").join(names, "category_id", "left")
    return own.withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))).orderBy(F.desc("ingested_at"), "id")


def categories(names: DataFrame, docs: DataFrame) -> DataFrame:
    """Categories with their number of active documents, by name."""
    count = docs.groupBy("category_id").agg(F.count(F.when(F.col("status") == "active", 1)).alias("document_count"))
    return names.join(count, F.col("id") == F.col("category_id"), "left").drop("category_id").withColumn("document_count", F.coalesce("document_count", F.lit(0))).orderBy("name")


def conversations(heads: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with the number of messages and the start of the last one, latest first."""
    own = messages.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("message_count"), F.substring(F.max_by("content", F.struct("created_at", "id")), 1, 100).alias("last_message"))
    return heads.join(own, F.col("id") == F.col("conversation_id"), "left").drop("conversation_id").withColumn("message_count", F.coalesce("message_count", F.lit(0))).orderBy(F.desc("updated_at"), "id")


def agents(agents: DataFrame, links: DataFrame, names: DataFrame) -> DataFrame:
    """Agents with their categories by name, in order of creation."""
    own = links.join(names.select(F.col("id").alias("category_id"), F.col("name").alias("category_name")), "category_id").groupBy("agent_id").agg(F.array_sort(F.collect_list(F.struct("category_name", "category_id"))).alias("categories"))
    return agents.join(own, F.col("id") == F.col("agent_id"), "left").drop("agent_id").orderBy("created_at", "id")

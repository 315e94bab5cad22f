"""Versions of documents: a batch of files against the documents that are known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def track(known: DataFrame, files: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The documents after the batch, and (seq, id, version, is_new, duplicate_of) for each file.

    A file whose hash is known, or came earlier in the batch, is a duplicate. Others get the next versions of
    their filename in order of ``seq``, and only the last of these is active.
    """
    first = files.groupBy("content_hash").agg(F.min("seq").alias("__first"))
    rows = files.join(first, "content_hash")
    rows = rows.join(known.select("content_hash", F.col("id").alias("__known"), F.col("version").alias("__version")), "content_hash", "left")
    rows = rows.withColumn("is_new", F.col("__known").isNull() & (F.col("seq") == F.col("__first")))
    top = known.groupBy("filename").agg(F.max("version").alias("__top"))
    by_name = Window.partitionBy("filename").orderBy("seq")
    fresh = rows.filter("is_new").join(top, "filename", "left")
    fresh = fresh.withColumn("version", (F.coalesce("__top", F.lit(0)) + F.row_number().over(by_name)).cast("int"))
    fresh = fresh.withColumn("__last", F.lead("seq").over(by_name).isNull()).withColumn("id", F.sha2(F.concat_ws("|", "filename", "content_hash"), 256))
    made = fresh.withColumn("status", F.when(F.col("__last"), "active").otherwise("deprecated")).withColumn("ingested_at", now).withColumn("deprecated_at", F.when(~F.col("__last"), now))
    superseded = fresh.select("filename").distinct().withColumn("__hit", F.lit(True))
    hit = F.coalesce("__hit", F.lit(False)) & (F.col("status") == "active")
    old = known.join(superseded, "filename", "left").withColumn("deprecated_at", F.when(hit, now).otherwise(F.col("deprecated_at"))).withColumn("status", F.when(hit, "deprecated").otherwise(F.col("status"))).drop("__hit")
    columns = known.columns
    after = old.select(*columns).unionByName(made.select(*[c if c in made.columns else F.lit(None).cast(known.schema[c].dataType).alias(c) for c in columns]))
    ids = fresh.select("content_hash", F.col("id").alias("__id"), F.col("version").alias("__v"))
    told = rows.join(ids, "content_hash", "left").select("seq", "filename", "content_hash", F.coalesce("__known", "__id").alias("id"), F.coalesce("__version", "__v").alias("version"), "is_new")
    return after, told


def active(documents: DataFrame) -> DataFrame:
    """The active row of the latest version of each filename."""
    order = Window.partitionBy("filename").orderBy(F.desc("version"))
    return documents.filter("status = 'active'").withColumn("__turn", F.row_number().over(order)).filter("__turn = 1").drop("__turn")


def history(documents: DataFrame, filename: str) -> DataFrame:
    return documents.filter(F.col("filename") == filename).orderBy(F.desc("version"))


def deprecate(documents: DataFrame, condition: Column, now: Column) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False)) & (F.col("status") == "active")
    return documents.withColumn("deprecated_at", F.when(hit, now).otherwise(F.col("deprecated_at"))).withColumn("status", F.when(hit, "deprecated").otherwise(F.col("status")))

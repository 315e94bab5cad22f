"""Streams: files that arrive are ingested batch by batch, and logs are rolled up by time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.plans.ingest import Ingestion


def ingest_stream(ingestion: Ingestion, folder: str, checkpoint: str) -> StreamingQuery:
    """Ingest files as they arrive in ``folder``; a batch that is repeated finds its files known by hash."""
    source = ingestion.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    named = source.select(F.regexp_extract("path", r"[^/]+$", 0).alias("path"), "length", "content", F.unix_micros("modificationTime").alias("arrived"))
    return named.writeStream.foreachBatch(lambda rows, _: ingestion.ingest(rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rollup(logs: DataFrame, at: str, by: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and kind, for streams (windows close when the watermark passes) and tables alike."""
    own = logs.withWatermark(at, late) if logs.isStreaming else logs
    return own.groupBy(F.window(at, window)["start"].alias("start"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))

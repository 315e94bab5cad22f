"""Token counts by a byte-level vocabulary: merges of byte pairs over the distinct pieces of the texts, joined back.

A piece is a match of the vocabulary's split pattern. Pieces are counted within a text before they are shuffled, each distinct one
is merged once, and its number of tokens goes back to all texts that hold it.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merged_size(piece: bytes, ranks: dict[bytes, int]) -> int:
    """How many tokens are left of a piece when the neighbours of the lowest rank have been merged until none has one."""
    if piece in ranks:
        return 1
    ends = list(range(len(piece) + 1))
    while len(ends) > 2:
        found = min(((ranks.get(piece[ends[i] : ends[i + 2]], len(ranks)), i) for i in range(len(ends) - 2)))
        if found[0] == len(ranks):
            break
        del ends[found[1] + 1]
    return len(ends) - 1


def bpe_counts(texts: DataFrame, path: str, pattern: str, item: str = "chunk_id", text: str = "content") -> DataFrame:
    """(item, n_tokens) of every text; ``path`` is a file of ranks and ``pattern`` what splits a text into pieces."""
    pieces = F.regexp_extract_all(F.col(text), F.lit("(?U)" + pattern), F.lit(0))
    own = texts.select(item, F.explode(pieces).alias("piece")).groupBy(item, "piece").agg(F.count(F.lit(1)).alias("n"))

    def run(batches):
        ranks = _ranks(path)
        for batch in batches:
            words = batch.column(0)
            yield pa.RecordBatch.from_arrays([words, pa.array([merged_size(w.encode(), ranks) for w in words.to_pylist()], pa.int64())], names=["piece", "size"])

    sizes = own.select("piece").distinct().mapInArrow(run, "piece string, size bigint")
    found = own.join(sizes, "piece").groupBy(item).agg(F.sum(F.col("n") * F.col("size")).alias("n_tokens"))
    return texts.select(item).join(found, item, "left").select(item, F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))

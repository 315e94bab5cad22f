"""Blocks of unit vectors against each other, inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of query vectors that are sent out at once, and the sides of one product.
QUERY_BYTES, QUERY_ROWS, ITEM_ROWS = 16 << 20, 512, 4096
#: Scores are compared after rounding, so equal vectors tie wherever they stand in a product.
DIGITS = 12


def units(column: pa.Array) -> np.ndarray:
    """The rows of a list column as vectors of length 1; one of length 0 stays so."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    length = np.linalg.norm(x, axis=1)[:, None]
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def arrow_type(kind: T.DataType) -> pa.DataType:
    return {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kind.simpleString()]


def query_blocks(queries: DataFrame, *more: str):
    """Queries (query_id, vec and ``more``) as Arrow tables in order of query_id, some QUERY_BYTES of vectors each."""
    own = queries.select("query_id", F.col("vec").cast("array<double>").alias("vec"), *more).filter("vec is not null")
    size = own.agg(F.sum(F.size("vec") * 8)).first()[0] or 0
    blocks = size // QUERY_BYTES + 1
    for k in range(blocks):
        few = own if blocks == 1 else own.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        yield few.toArrow().sort_by("query_id")


def largest(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Of each row's allowed places those whose score is one of the row's k largest; all that tie with the last stay."""
    crowded = np.flatnonzero(allowed.sum(1) > k)
    if len(crowded):
        own = np.where(allowed[crowded], scores[crowded], -np.inf)
        allowed[crowded] &= own >= np.partition(own, own.shape[1] - k, axis=1)[:, -k, None]
    return allowed


class Floors:
    """The k-th best score so far of each query, below which nothing can matter."""

    #: Beyond this k the scores themselves aren't kept, only the best k-th of any block.
    KEPT = 256

    def __init__(self, queries: int, k: int):
        self.k = k
        self.floor = np.full(queries, -np.inf)
        self.top = np.full((queries, k), -np.inf) if k <= self.KEPT else None

    def raise_by(self, part: slice, scores: np.ndarray, allowed: np.ndarray) -> None:
        if scores.shape[1] < self.k and self.top is None:
            return
        own = np.where(allowed, scores, -np.inf)
        if own.shape[1] > self.k:
            own = np.partition(own, own.shape[1] - self.k, axis=1)[:, -self.k :]
        if self.top is not None:
            both = np.concatenate([self.top[part], own], axis=1)
            own = self.top[part] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
        self.floor[part] = np.maximum(self.floor[part], own.min(1))

"""Hard negatives by blocked dense products.

Vectors are scaled to whole numbers and packed as rows of doubles. A group of anchors of bounded size is broadcast; each
task multiplies it by blocks of its candidates (float64 products of whole numbers, exact while no partial
sum can pass 2^53, which is checked for each pair of blocks; beyond that Python's integers are used). The first pass keeps the
best positives of each anchor, the second the best negatives within each positive's window of scores. A task keeps the best
k of what it has seen, in order of score and then of vec_id, so partial results merge: a row for each
place of each anchor and task is shuffled, and never a pair. More anchors than a group holds make more groups, dealt by hash, each of
which is written out, so a lost executor costs one task and a lost driver one group.

Every anchor meets every candidate, which the exact result asks for: work grows with anchors x vectors, memory doesn't.

Defined cases: rows with a null vec_id, label or vector, or with a null or non-finite component take no part; of rows that share
a vec_id the one with the least label and then the least vector counts; a shorter vector counts as filled up with zeros; equal
scores are in order of vec_id; scores beyond 64 bits count as the nearest 64-bit integer; other columns are ignored, whatever
their names; an empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm import common

#: Bytes of anchors that are broadcast at once, and the sides of a product.
GROUP_BYTES, ANCHOR_ROWS, CANDIDATE_ROWS = 16 << 20, 512, 4096
EXACT = 2**53
MOST = 2**63 - 1

_PACKED = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("vector", pa.binary())])


def _pack(scale: float):
    def run(batches):
        for batch in batches:
            column = batch.column("embedding")
            values = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)) + 0.0
            at = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            packed = pa.array([values[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), packed], schema=_PACKED)

    return run


def packed(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part; a vector is its components, scaled and rounded down, as doubles."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    own = own.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & usable)
    if own.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        own = own.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("least")).select("vec_id", "least.*")
    return common.cut(own.mapInArrow(_pack(scale), "vec_id bigint, label bigint, vector binary"))


def _matrix(vectors: list[bytes]) -> np.ndarray:
    width = max((len(v) for v in vectors), default=0)
    if all(len(v) == width for v in vectors):
        return np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), width // 8)
    return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in vectors), "<f8").reshape(len(vectors), width // 8)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of rows of whole numbers: doubles that are exact, or else 64-bit integers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if width and len(a) and len(b) and float(np.abs(a).max()) * float(np.abs(b).max()) * width >= EXACT:
        whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
        return np.clip(whole(a) @ whole(b).T, -MOST, MOST).astype(np.int64)
    return a @ b.T


def _first(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that are allowed and among the first k of their row; equal scores are in order of column."""
    crowded = np.flatnonzero(allowed.sum(axis=1) > k)
    if len(crowded):
        some, n = scores[crowded], scores.shape[1]
        if some.dtype == np.float64 and np.abs(some).max() < EXACT / n / 2:
            key = np.where(allowed[crowded], some * n - np.arange(n), -np.inf)
            allowed[crowded] = key >= np.partition(key, n - k, axis=1)[:, n - k, None]
        else:
            for i in crowded:
                at = np.flatnonzero(allowed[i])
                allowed[i] = False
                allowed[i, at[np.argsort(-scores[i, at], kind="stable")[:k]]] = True
    return np.nonzero(allowed)


class _Best:
    """The best k (score, id) seen of each of some groups."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(groups, -MOST, np.int64)  # the score that a new one must reach

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        group, score, ids = np.concatenate([self.group, group]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        turn = np.arange(len(group)) - np.searchsorted(group, group)
        last = turn == self.k - 1
        self.floor[group[last]] = score[last]
        self.group, self.score, self.id = (x[turn < self.k] for x in (group, score, ids))


def _blocks(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, CANDIDATE_ROWS):
            rows = batch.slice(at, CANDIDATE_ROWS)
            ids, labels = (rows.column(c).to_numpy() for c in ("vec_id", "label"))
            order = np.argsort(ids, kind="stable")
            yield ids[order], labels[order], _matrix(rows.column("vector").to_pylist())[order]


_POSITIVE = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
_NEGATIVE = pa.schema([*_POSITIVE, ("negative_id", pa.int64()), ("negative_score", pa.int64())])


def _positives(anchors, k: int):
    def run(batches):
        own_ids, own_labels, own = anchors.value
        best = _Best(len(own_ids), k)
        for ids, labels, x in _blocks(batches):
            for i in range(0, len(own_ids), ANCHOR_ROWS):
                part = slice(i, i + ANCHOR_ROWS)
                scores = products(own[part], x)
                allowed = (own_labels[part, None] == labels) & (own_ids[part, None] != ids) & (scores >= best.floor[part, None])
                row, col = _first(scores, allowed, k)
                best.add(row + i, scores[row, col].astype(np.int64), ids[col])
        yield pa.RecordBatch.from_arrays([own_ids[best.group], best.id, best.score], schema=_POSITIVE)

    return run


def _negatives(anchors, positives, k: int, low: int, high: int):
    def run(batches):
        own_ids, own_labels, own = anchors.value
        place, found_ids, found = positives.value  # by anchor
        lows = np.array([-(-low * int(s) // 100) for s in found], np.int64)
        highs = np.array([high * int(s) // 100 for s in found], np.int64)
        best = _Best(len(place), k)
        for ids, labels, x in _blocks(batches):
            for i in range(0, len(own_ids), ANCHOR_ROWS):
                first, last = np.searchsorted(place, [i, i + ANCHOR_ROWS])
                if first == last:
                    continue
                scores = products(own[i : i + ANCHOR_ROWS], x)
                other = own_labels[i : i + ANCHOR_ROWS, None] != labels
                turn = np.arange(first, last) - np.searchsorted(place, place[first:last])
                for t in range(turn.max() + 1):
                    pairs = first + np.flatnonzero(turn == t)
                    rows = place[pairs] - i
                    own_scores = scores[rows]
                    allowed = other[rows] & (own_scores <= highs[pairs, None]) & (own_scores >= np.maximum(lows, best.floor)[pairs, None])
                    row, col = _first(own_scores, allowed, k)
                    best.add(pairs[row], own_scores[row, col].astype(np.int64), ids[col])
        at = best.group
        yield pa.RecordBatch.from_arrays([own_ids[place[at]], found_ids[at], found[at], best.id, best.score], schema=_NEGATIVE)

    return run


def _ranked(rows: DataFrame, group: list[str], score: str, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc(score), key)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the packed ``vectors``.

    The negatives of a positive have ``low`` to ``high`` percent of its score.
    """
    spark = vectors.sparkSession
    asked = vectors.filter(anchor)
    size = asked.agg(F.sum(F.octet_length("vector") + 16)).first()[0] or 0
    groups = size // GROUP_BYTES + 1
    made = []
    for g in range(groups):
        few = asked if groups == 1 else asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g)
        block = few.toArrow()  # some GROUP_BYTES
        if not block.num_rows:
            continue
        ids = block.column("vec_id").to_numpy()
        own = spark.sparkContext.broadcast((ids, block.column("label").to_numpy(), _matrix(block.column("vector").to_pylist())))
        near = _ranked(vectors.mapInArrow(_positives(own, positives), "anchor_id bigint, positive_id bigint, positive_score bigint"), ["anchor_id"], "positive_score", "positive_id", positives)
        near = near.select("anchor_id", "positive_id", "positive_score").toArrow()  # ``positives`` rows an anchor
        place = np.searchsorted(np.sort(ids), near.column("anchor_id").to_numpy())
        place = np.argsort(ids, kind="stable")[place] if len(place) else place
        order = np.argsort(place, kind="stable")
        windows = spark.sparkContext.broadcast((place[order], *(near.column(c).to_numpy()[order] for c in ("positive_id", "positive_score"))))
        kinds = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
        found = _ranked(vectors.mapInArrow(_negatives(own, windows, negatives, low, high), kinds), ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
        made.append(common.cut(found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")))
        for sent in (own, windows):
            sent.unpersist()
    if not made:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings")
    noisy = rows.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    return mine(packed(noisy), F.col("vec_id") % 100 == 0)


SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS turn FROM s WHERE same),
n AS (SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score WHERE p.turn <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

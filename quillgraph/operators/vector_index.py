"""A partitioned vector index with exact answers.

Building. Vectors of length 1 are dealt to the nearest of up to ``MAX_CELLS`` centroids (spherical k-means on at most ``SAMPLE``
vectors; how well they fit changes the speed, never the answer). Each cell knows the largest angle between its
centroid and a member. Cells are written in order, so a reader of few cells reads few row groups; a cell of many members
has several blocks.

Searching. By the triangle inequality no member of a cell is nearer to a query than the angle to the centroid less the
cell's largest angle. A query first meets the cells of nearest centroids, until they hold ``k`` members. Its k-th best score then rules
out every cell whose bound is lower, and only the others are met. A cell's queries and members come
together by (cell, block of members, block of queries), so a cell that everybody asks for is many small groups.
Searches for all items above a score ask with as many vectors as there are, and where no cell is ruled out each would be sent to every
cell. There cells are put together to groups of ``BLOCK`` members within each ``same``, and a query is sent once to a group.

Only centroids and one row for each cell are sent out, MAX_CELLS at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.operators import dense
from quillgraph.sources.catalog import settled

SAMPLE, MAX_CELLS, ROUNDS = 20_000, 4096, 8
#: Members, and queries, of one group.
BLOCK = 4096
#: Rows that a task hands on at once.
SENT_ROWS = 4096
SLACK = 1e-7


@dataclass
class Cells:
    """Of each cell the centroid, the number of members and their largest angle to it."""

    centres: np.ndarray
    sizes: np.ndarray
    angles: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and cell the largest cosine that a member can have."""
        if len(self.centres) == 1:
            return np.full((len(q), 1), SLACK)
        angle = np.arccos(np.clip(q @ self.centres.T, -1, 1))
        most = np.cos(np.maximum(0.0, angle - self.angles)) + SLACK
        # Vectors of length 0 have the cosine 0 with everything; the last cell holds those of the index.
        most[:, -1] = SLACK
        most[~q.any(1)] = SLACK
        return most


@dataclass
class VectorIndex:
    """``rows`` (cell, item, unit and ``same``, if given) in files, and what is known of the cells."""

    rows: DataFrame
    item: str
    cells: Cells
    same: str | None = None


def _centres(x: np.ndarray, cells: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = x[rng.permutation(len(x))[:cells]]
    for _ in range(ROUNDS):
        own = np.concatenate([(x[i : i + 4096] @ centre.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        length = np.linalg.norm(total, axis=1)
        centre = np.where(length[:, None] > 1e-9, total / np.maximum(length, 1e-9)[:, None], centre)
    return centre


def build(vectors: DataFrame, item: str, vector: str = "embedding", cells: int | None = None, seed: int = 17, same: str | None = None) -> VectorIndex:
    """Vectors that are null take no part. ``cells`` is about the square root of their number, unless it is given.

    With ``same``, a string column, queries meet only members that are equal to them in it.
    """
    spark = vectors.sparkSession
    own = vectors.select(item, F.col(vector).cast("array<double>").alias("vec"), *([same] if same else [])).filter("vec is not null")
    total = own.count()
    cells = max(1, min(MAX_CELLS, cells or round(total**0.5)))
    sample = own.orderBy(F.xxhash64(item)).limit(SAMPLE).select("vec").toArrow()  # SAMPLE rows at most
    x = dense.units(sample.column(0))
    x = x[x.any(1)]
    centres = _centres(np.unique(x, axis=0), cells, seed) if len(x) else np.zeros((0, x.shape[1]))
    none, blocks = len(centres), max(1, total // BLOCK)

    def assign(batches):
        for batch in batches:
            u = dense.units(batch.column(1))
            cell = np.concatenate([np.zeros(0, int), *[(u[i : i + SENT_ROWS] @ centres.T).argmax(1) for i in range(0, len(u), SENT_ROWS)]]) if none else np.zeros(len(u), int)
            cell[~u.any(1)] = none
            close = np.where(cell < none, (u * np.vstack([centres, np.zeros(u.shape[1])])[cell]).sum(1), 1.0) if len(u) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column(0), pa.array(list(u), pa.list_(pa.float64())), pa.array(close), *batch.columns[2:]], names=["cell", item, "unit", "close", *([same] if same else [])])

    kind = vectors.schema[item].dataType.simpleString()
    dealt = own.mapInArrow(assign, f"cell int, `{item}` {kind}, unit array<double>, close double" + (f", `{same}` string" if same else ""))
    dealt = dealt.withColumn("turn", F.pmod(F.xxhash64(item), F.lit(blocks)))
    rows = settled(dealt.repartitionByRange("cell", "turn").sortWithinPartitions("cell"))
    sizes, least = np.zeros(none + 1, np.int64), np.ones(none + 1)
    for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("close").alias("least")).collect():  # a row for each cell
        sizes[r["cell"]], least[r["cell"]] = r["n"], r["least"]
    return VectorIndex(rows, item, Cells(np.vstack([centres, np.zeros((1, centres.shape[1]))]), sizes, np.arccos(np.clip(least, -1, 1)) + SLACK), same)


def _plan(cells: Cells, id_type: T.DataType, k: int | None, above: float | None, first: bool):
    """The cells that a query meets: the nearest ones, or those that a known score (``least``) doesn't rule out."""
    live = cells.sizes > 0

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, dense.QUERY_ROWS):
                batch = whole.slice(lo, dense.QUERY_ROWS)
                most = cells.bounds(dense.units(batch.column(1)))
                if above is not None:
                    met = live & (most > above)
                else:
                    met = np.broadcast_to(live, most.shape).copy()
                if k is not None:
                    order = np.argsort(np.where(live, -most, np.inf), axis=1, kind="stable")
                    before = np.cumsum(cells.sizes[order], axis=1) - cells.sizes[order]
                    nearest = np.zeros(met.shape, bool)
                    np.put_along_axis(nearest, order, before < k, axis=1)
                    nearest &= live
                    if first:
                        met &= nearest
                    else:
                        least = batch.column("least").to_numpy(zero_copy_only=False)
                        met &= ~nearest & (most >= np.where(np.isnan(least), -2.0, least)[:, None])
                every, cells_met = np.nonzero(met)
                for at in range(0, len(every), SENT_ROWS):
                    row, cell = pa.array(every[at : at + SENT_ROWS]), cells_met[at : at + SENT_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column(0).take(row).cast(dense.arrow_type(id_type)), batch.column(1).take(row)], names=["cell", "query_id", "vec"])

    return run


def _scores(index: VectorIndex, id_type: T.DataType, k: int | None, above: float | None):
    """The scores of a group's queries and members that count, and their schema."""
    item = index.item
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField(item, index.rows.schema[item].dataType), T.StructField("score", T.DoubleType()), T.StructField("met", T.LongType())])
    kinds = [dense.arrow_type(f.dataType) for f in schema.fields[:2]]

    def score(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[pa.Array]] = [[], [], [], []]
        if queries.num_rows and rows.num_rows:
            q, x = dense.units(queries.column("vec")), np.array(rows.column("unit").combine_chunks().flatten()).reshape(rows.num_rows, -1)
            for at in range(0, len(q), dense.QUERY_ROWS):
                s = np.round(q[at : at + dense.QUERY_ROWS] @ x.T, dense.DIGITS)
                allowed = s > above if above is not None else np.ones(s.shape, bool)
                if k is not None:
                    allowed = dense.largest(s, allowed, k)
                i, j = np.nonzero(allowed)
                seen = np.full(len(i), 0)
                seen[np.unique(i, return_index=True)[1]] = len(x)
                for held, new in zip(out, (queries.column("query_id").combine_chunks().take(pa.array(i + at)).cast(kinds[0]), rows.column(item).combine_chunks().take(pa.array(j)).cast(kinds[1]), pa.array(s[i, j], pa.float64()), pa.array(seen, pa.int64())), strict=True):
                    held.append(new)
        types = [*kinds, pa.float64(), pa.int64()]
        return pa.table([pa.chunked_array(held, t) for held, t in zip(out, types, strict=True)], names=schema.names)

    return score, schema


def _meet(index: VectorIndex, asked: DataFrame, k: int | None, above: float | None) -> DataFrame:
    """(query_id, item, score, met) for queries and the cells they meet; ``met`` counts the vectors compared, once a group."""
    spark = asked.sparkSession
    item, id_type = index.item, asked.schema["query_id"].dataType
    wanted = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each cell
    parts = spark.createDataFrame([(int(c), int(index.cells.sizes[c] // BLOCK + 1), int(n // BLOCK + 1)) for c, n in wanted.items()], "cell int, blocks int, sides int")
    asked = asked.join(F.broadcast(parts), "cell")
    left = asked.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id"), F.col("sides")).cast("int").alias("side"), "query_id", "vec")
    members = index.rows.filter(F.col("cell").isin([int(c) for c in wanted])).join(F.broadcast(parts), "cell")
    right = members.select("cell", F.pmod(F.xxhash64(item, F.lit(1)), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("side"), item, "unit")
    keys = ["cell", "block", "side"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(*_scores(index, id_type, k, above))


def search(index: VectorIndex, queries: DataFrame, k: int, above: float | None = None) -> DataFrame:
    """(query_id, item, score, rank, met): the ``k`` items of largest cosine, exactly, and how many vectors were looked at for them.

    ``queries`` are (query_id, vec) with distinct ids.
    """
    item, id_type = index.item, queries.schema["query_id"].dataType
    own = settled(queries.select("query_id", F.col("vec").cast("array<double>").alias("vec")).filter("vec is not null"))
    planned = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("query_id", id_type), T.StructField("vec", T.ArrayType(T.DoubleType()))])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), item)

    def best(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    early = settled(_meet(index, settled(own.mapInArrow(_plan(index.cells, id_type, k, above, True), planned)), k, above))
    least = best(early).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    known = own.join(least, "query_id", "left").select("query_id", "vec", "least")
    late = _meet(index, settled(known.mapInArrow(_plan(index.cells, id_type, k, above, False), planned)), k, above)
    every = early.unionByName(late).withColumn("met", F.sum("met").over(Window.partitionBy("query_id")))
    return best(every).select("query_id", item, "score", "rank", "met")


def _groups(index: VectorIndex) -> dict[str | None, tuple[np.ndarray, np.ndarray, int]]:
    """(first group of each cell, groups of each cell, blocks of queries) by value of ``same``; what has at most BLOCK members isn't listed and is one group.

    Cells follow each other into a group until it holds BLOCK members; a cell of more has groups of its own.
    """
    value = F.col(index.same) if index.same else F.lit(None).cast("string")
    count = index.rows.groupBy(value.alias("value"), "cell").agg(F.count(F.lit(1)).alias("n"))
    count = count.withColumn("total", F.sum("n").over(Window.partitionBy("value"))).filter(F.col("total") > BLOCK)
    found: dict = {}
    for r in count.collect():  # members / BLOCK values at most, a row for each of their cells
        found.setdefault(r["value"], {})[r["cell"]] = r["n"]
    out = {}
    for value, sizes in found.items():
        start, parts, group, held = np.zeros(len(index.cells.sizes), int), np.ones(len(index.cells.sizes), int), 0, 0
        for cell in sorted(sizes):
            if held and held + sizes[cell] > BLOCK:
                group, held = group + 1, 0
            start[cell], parts[cell], held = group, -(-sizes[cell] // BLOCK), held + sizes[cell]
            if parts[cell] > 1:
                group, held = group + parts[cell], 0
        out[value] = start, parts, -(-sum(sizes.values()) // BLOCK)
    return out


def _sent(cells: Cells, id_type: T.DataType, above: float, groups: dict, same: str | None):
    """Each query once for each group that it meets."""
    live = cells.sizes > 0

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, dense.QUERY_ROWS):
                part = batch.slice(lo, dense.QUERY_ROWS)
                met = live & (cells.bounds(dense.units(part.column(1))) > above)
                values = np.array(part.column(2).to_pylist() if same else [None] * part.num_rows, object)
                for value in dict.fromkeys(values):
                    own = np.flatnonzero(values == value)
                    start, parts, sides = groups.get(value, (np.zeros(met.shape[1], int), np.ones(met.shape[1], int), 1))
                    place = np.zeros((met.shape[1], int((start + parts).max())), np.float32)
                    for cell in np.flatnonzero(live):
                        place[cell, start[cell] : start[cell] + parts[cell]] = 1
                    row, group = np.nonzero(met[own].astype(np.float32) @ place)
                    for at in range(0, len(row), SENT_ROWS):
                        few = pa.array(own[row[at : at + SENT_ROWS]])
                        yield pa.RecordBatch.from_arrays([pa.array(group[at : at + SENT_ROWS], pa.int32()), pa.array(np.full(len(few), sides), pa.int32()), part.column(0).take(few).cast(dense.arrow_type(id_type)), part.column(1).take(few), *([part.column(2).take(few)] if same else [])], names=["group", "sides", "query_id", "vec", *([same] if same else [])])

    return run


def within(index: VectorIndex, queries: DataFrame, above: float) -> DataFrame:
    """(query_id, item, score, met) of all items whose cosine is ``above``; ``queries`` have the index's ``same`` column, if it has one."""
    same = [index.same] if index.same else []
    item, id_type, spark = index.item, queries.schema["query_id"].dataType, queries.sparkSession
    groups = _groups(index)
    planned = T.StructType([T.StructField("group", T.IntegerType()), T.StructField("sides", T.IntegerType()), T.StructField("query_id", id_type), T.StructField("vec", T.ArrayType(T.DoubleType())), *(T.StructField(c, T.StringType()) for c in same)])
    own = queries.select("query_id", F.col("vec").cast("array<double>").alias("vec"), *same).filter("vec is not null")
    sent = own.mapInArrow(_sent(index.cells, id_type, above, groups, index.same), planned)
    left = sent.select("group", F.pmod(F.xxhash64("query_id"), F.col("sides")).cast("int").alias("side"), "query_id", "vec", *same)
    places = [(value, c, int(start[c]), int(parts[c]), int(sides)) for value, (start, parts, sides) in groups.items() for c in np.flatnonzero(index.cells.sizes)]
    known = spark.createDataFrame([(v, int(c), *rest) for v, c, *rest in places], "value string, at int, start int, parts int, sides int")
    here = (F.col("cell") == F.col("at")) & ((F.col(index.same) if index.same else F.lit(None).cast("string")).eqNullSafe(F.col("value")))
    members = index.rows.join(F.broadcast(known), here, "left").fillna({"start": 0, "parts": 1, "sides": 1})
    right = members.select((F.col("start") + F.pmod(F.xxhash64(item, F.lit(1)), F.col("parts"))).cast("int").alias("group"), F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("side"), item, "unit", *same)
    keys = ["group", "side", *same]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(*_scores(index, id_type, None, above))

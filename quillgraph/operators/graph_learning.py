"""Node and relation vectors: neighbourhood aggregation (two layers) and translations (TransE).

TransE trains pairs of buckets of entities, a task each. The weights of aggregation are trained on minibatches of edges that are drawn from all of
them, with the sampled neighbourhoods of their ends; tasks send back sums of gradients. ``train_sage`` and ``train_transe`` do the same for a graph that one process holds. Inference is distributed: sampled neighbours are joined and averaged, and the weights go out as constants.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.config import DEFAULT, EngineConfig
from quillgraph.functions.vectors import l2_normalize
from quillgraph.sources.catalog import settled

SLICE_EDGES = 2_000_000
#: Numbers in the vectors of a bucket, of which a task holds two, and meetings of each pair of buckets.
BUCKET_NUMBERS, PASSES = 12_800_000, 4
#: Edges of a minibatch, and the tasks that work on it.
BATCH_EDGES, BATCH_PARTS = 1024, 8


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, neighbours) from (a, b) edges, without self-loops."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    return both.groupBy(F.col("a").alias("node")).agg(F.sort_array(F.collect_list("b")).alias("neighbours"))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _slices(edges: DataFrame) -> list[DataFrame]:
    """All of ``edges``, dealt into slices by hash."""
    n = -(-edges.count() // SLICE_EDGES)
    turn = F.pmod(F.xxhash64(*edges.columns), F.lit(n))
    return [edges.filter(turn == k) for k in range(n)] if n > 1 else [edges]


class Sage:
    """Two layers of relu(x . own + mean(neighbours) . near), then unit length."""

    def __init__(self, dims: tuple[int, int, int], seed: int):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.normal(0, np.sqrt(2 / (a + b)), (a, b))
        self.params = {"own0": draw(dims[0], dims[1]), "near0": draw(dims[0], dims[1]), "own1": draw(dims[1], dims[2]), "near1": draw(dims[1], dims[2])}

    def forward(self, x: np.ndarray, mean) -> tuple[np.ndarray, tuple]:
        p = self.params
        m0 = mean(x)
        h = np.maximum(x @ p["own0"] + m0 @ p["near0"], 0)
        m1 = mean(h)
        z = h @ p["own1"] + m1 @ p["near1"]
        return _unit(z), (x, m0, h, m1, z)


def train_sage(features: np.ndarray, edges: np.ndarray, config: EngineConfig = DEFAULT, model: Sage | None = None) -> Sage:
    """Link prediction by logistic loss on edges and random pairs, with Adam; goes on with ``model`` if given."""
    model = model or Sage((features.shape[1], *config.sage_dims[1:]), config.seed)
    rng = np.random.default_rng(config.seed)
    n = len(features)
    ends = np.concatenate([edges, edges[:, ::-1]])
    ends = ends[np.argsort(ends[:, 0], kind="stable")]
    at = np.searchsorted(ends[:, 0], np.arange(n + 1))
    size = np.diff(at)
    adam = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.params.items()}
    for epoch in range(1, config.train_epochs + 1):
        pick = (rng.random((n, config.sage_neighbours)) * np.maximum(size, 1)[:, None]).astype(int)
        near = np.where(size[:, None] > 0, ends[np.minimum(at[:-1, None] + pick, max(len(ends) - 1, 0)), 1] if len(ends) else 0, np.arange(n)[:, None])
        mean = lambda v, near=near: v[near].mean(1)
        out, (x, m0, h, m1, z) = model.forward(features, mean)
        few = edges[rng.permutation(len(edges))[:4096]]
        a = np.concatenate([few[:, 0], np.repeat(few[:, 0], config.negatives)])
        b = np.concatenate([few[:, 1], rng.integers(0, n, len(few) * config.negatives)])
        y = np.concatenate([np.ones(len(few)), np.zeros(len(few) * config.negatives)])
        slope = (1 / (1 + np.exp(-(out[a] * out[b]).sum(1))) - y) / len(y)
        grad = np.zeros_like(out)
        np.add.at(grad, a, slope[:, None] * out[b])
        np.add.at(grad, b, slope[:, None] * out[a])
        length = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        gz = (grad - out * (grad * out).sum(1, keepdims=True)) / length

        def spread(g, near=near):
            back = np.zeros((n, g.shape[1]))
            np.add.at(back, near.ravel(), np.repeat(g / near.shape[1], near.shape[1], axis=0))
            return back

        gh = (gz @ model.params["own1"].T + spread(gz @ model.params["near1"].T)) * (h > 0)
        grads = {"own1": h.T @ gz, "near1": m1.T @ gz, "own0": x.T @ gh, "near0": m0.T @ gh}
        for k, g in grads.items():
            one, two = adam[k]
            one += 0.1 * (g - one)
            two += 0.001 * (g * g - two)
            model.params[k] -= config.learning_rate * (one / (1 - 0.9**epoch)) / (np.sqrt(two / (1 - 0.999**epoch)) + 1e-8)
    return model


def infer_sage(nodes: DataFrame, edges: DataFrame, params: dict[str, np.ndarray], neighbours: int = DEFAULT.sage_neighbours) -> DataFrame:
    """(node, embedding) for (node, x) features: each layer joins up to ``neighbours`` neighbours, chosen by hash."""
    near = _near(edges, neighbours)
    current = nodes.select("node", F.col("x").cast("array<double>").alias("x"))
    for layer in ("0", "1"):
        width = params[f"own{layer}"].shape[0]
        listed = near.join(current.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sort_array(F.collect_list("x")).alias("all"))
        rows = current.join(_means(listed, "m"), "node", "left").select("node", "x", F.coalesce("m", "x").alias("m"))
        own, other, last = params[f"own{layer}"], params[f"near{layer}"], layer == "1"

        def run(batches, own=own, other=other, last=last, width=width):
            for batch in batches:
                x, m = (batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if batch.num_rows else np.zeros((0, width)) for k in (1, 2))
                y = x @ own + m @ other
                y = y if last else np.maximum(y, 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(y), pa.list_(pa.float64()))], names=["node", "x"])

        current = rows.mapInArrow(run, "node string, x array<double>")
    return current.select("node", l2_normalize("x").alias("embedding"))


def _translate(ent: np.ndarray, rel: np.ndarray, triples: np.ndarray, epochs: int, config: EngineConfig, rng) -> tuple[np.ndarray, np.ndarray]:
    """Passes over the triples by margin ranking against triples with one end replaced, from the given vectors on."""
    for _ in range(epochs):
        ent = _unit(ent)
        for few in np.array_split(triples[rng.permutation(len(triples))], max(1, len(triples) // 512)):
            if not len(few):
                continue
            h, r, t = few.T
            head = rng.random(len(few)) < 0.5
            other = rng.integers(0, len(ent), len(few))
            nh, nt = np.where(head, other, h), np.where(head, t, other)
            good, bad = ent[h] + rel[r] - ent[t], ent[nh] + rel[r] - ent[nt]
            lg, lb = (np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in (good, bad))
            active = (config.margin + lg - lb > 0) * config.learning_rate
            gg, gb = active * good / lg, active * bad / lb
            for index, g in ((h, -gg), (t, gg), (nh, gb), (nt, -gb)):
                np.add.at(ent, index, g)
            np.add.at(rel, r, gb - gg)
            moved = np.unique(np.concatenate([h, t, nh, nt]))  # the others have length 1 still
            ent[moved] = _unit(ent[moved])
    return _unit(ent), rel


def train_transe(triples: np.ndarray, n_entities: int, n_relations: int, dim: int = DEFAULT.part_dim, config: EngineConfig = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """Entity (unit length) and relation vectors with h + r near t, for a graph that one process holds."""
    rng = np.random.default_rng(config.seed)
    ent, rel = (_unit(rng.uniform(-6 / np.sqrt(dim), 6 / np.sqrt(dim), (k, dim))) for k in (n_entities, n_relations))
    return _translate(ent, rel, triples, config.train_epochs, config, rng)


def matchings(n: int) -> list[list[tuple[int, int]]]:
    """Rounds that pair each of ``n`` buckets with itself, then each with every other once; no bucket is twice in a round."""
    rounds = [[(i, i) for i in range(n)]]
    even = n + n % 2
    for k in range(even - 1 if n > 1 else 0):
        pairs = [(k, even - 1)] + [((k + i) % (even - 1), (k - i) % (even - 1)) for i in range(1, even // 2)]
        rounds.append([(min(p), max(p)) for p in pairs if max(p) < n])
    return rounds


_VECTORS = "name string, vec array<double>, relation boolean"


def _train_pair(rel_names: list[str], rel: np.ndarray, dim: int, epochs: int, config: EngineConfig):
    place_of = {n: i for i, n in enumerate(rel_names)}

    def run(key, edges: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        vectors, edges = vectors.sort_values("name"), edges.sort_values(["h", "r", "t"])
        names = vectors["name"].to_numpy()
        ent = np.stack(vectors["vec"].to_list()) if len(vectors) else np.zeros((0, dim))
        new = rel.copy()
        if len(edges):
            triples = np.stack([np.searchsorted(names, edges["h"]), edges["r"].map(place_of), np.searchsorted(names, edges["t"])], 1).astype(int)
            ent, new = _translate(ent, new, triples, epochs, config, np.random.default_rng([config.seed, int(key[0])]))
        used = sorted(set(edges["r"]))
        return pd.concat(
            [
                pd.DataFrame({"name": names, "vec": list(ent), "relation": False}),
                pd.DataFrame({"name": used, "vec": [new[place_of[r]] - rel[place_of[r]] for r in used], "relation": True}),
            ]
        )

    return run


def transe(triples: DataFrame, dim: int = DEFAULT.part_dim, config: EngineConfig = DEFAULT, bucket_entities: int | None = None, passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
    """(node, embedding) and (relation_type, embedding) for (h, r, t) rows; both empty without a triple.

    Entities are dealt to buckets by a hash of their names, and edges to pairs of buckets. A round trains disjoint pairs, a task
    each, which holds the vectors and edges of its two buckets alone; rounds go on until all pairs have met, ``passes`` times in all, with
    its share of the epochs at each meeting. Vectors are written between rounds. Relation types, which are few, move by the mean of what the
    pairs that have them found. Names of entities never leave the executors.
    """
    spark = triples.sparkSession
    edges = triples.select("h", "r", "t").distinct()
    kinds = sorted(r["r"] for r in edges.select("r").distinct().collect())  # a row for each relation type
    names = settled(edges.select(F.explode(F.array("h", "t")).alias("name")).distinct())
    buckets = max(1, -(-names.count() // (bucket_entities or max(1, BUCKET_NUMBERS // dim))))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")
    edges = settled(edges.select("h", "r", "t", bucket("h").alias("hb"), bucket("t").alias("tb")))
    span, seed = 6 / np.sqrt(dim), config.seed

    def start(batches):
        for batch in batches:
            own = [np.random.default_rng([seed, zlib.crc32(n.encode())]).uniform(-span, span, dim) for n in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(_unit(np.array(own).reshape(-1, dim))), pa.list_(pa.float64()))], names=["name", "vec"])

    vectors = settled(names.mapInArrow(start, "name string, vec array<double>").withColumn("bucket", bucket("name")))
    rel = _unit(np.random.default_rng(seed).uniform(-span, span, (len(kinds), dim)))
    passes = 1 if buckets == 1 else min(passes, config.train_epochs)
    for turn in range(passes if kinds else 0):
        epochs = config.train_epochs * (turn + 1) // passes - config.train_epochs * turn // passes
        for pairs in matchings(buckets):
            of = {b: k for k, p in enumerate(pairs) for b in p}
            pair = F.create_map(*[F.lit(x) for b, k in of.items() for x in (b, k)])  # a number for each bucket
            own = F.col("hb") == F.col("tb") if pairs[0][0] == pairs[0][1] else F.col("hb") != F.col("tb")
            met = edges.filter(own).withColumn("pair", pair[F.col("hb")]).filter(F.col("pair") == pair[F.col("tb")]).select("pair", "h", "r", "t")
            inside = vectors.withColumn("pair", pair[F.col("bucket")])
            made = met.groupBy("pair").cogroup(inside.filter("pair is not null").select("pair", "name", "vec").groupBy("pair")).applyInPandas(_train_pair(kinds, rel, dim, epochs, config), _VECTORS)
            made = settled(made)
            vectors = made.filter("not relation").select("name", "vec", bucket("name").alias("bucket")).unionByName(inside.filter("pair is null").drop("pair"))
            moved = made.filter("relation").groupBy("name").agg(*[F.avg(F.col("vec")[i]).alias(str(i)) for i in range(dim)])
            for r in moved.collect():  # a row for each relation type
                rel[kinds.index(r["name"])] += np.array(r[1:])
    return (
        vectors.select(F.col("name").alias("node"), F.col("vec").alias("embedding")),
        spark.createDataFrame([(n, v.tolist()) for n, v in zip(kinds, rel)], "relation_type string, embedding array<double>"),
    )


# Minibatches

def _means(rows: DataFrame, column: str) -> DataFrame:
    """(node, column) means of vectors that are listed for each node, some ``sage_neighbours`` at most."""

    def run(batches):
        for batch in batches:
            own = [np.mean(v, axis=0).tolist() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.float64()))], names=["node", column])

    return rows.mapInArrow(run, f"node string, {column} array<double>")


def _near(edges: DataFrame, neighbours: int) -> DataFrame:
    """(a, b): up to ``neighbours`` distinct neighbours of each node, chosen by hash."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    order = Window.partitionBy("a").orderBy(F.xxhash64("a", "b"), "b")
    return both.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= neighbours).select("a", "b")


def minibatches(nodes: DataFrame, edges: DataFrame, config: EngineConfig = DEFAULT, batch_edges: int = BATCH_EDGES, parts: int = BATCH_PARTS) -> DataFrame:
    """(epoch, part, edge, a, b): for each epoch about ``batch_edges`` edges, drawn by hash, with what two layers need of either end.

    An end is a list of rows (features, mean of the neighbours' features): its own, then one for each of its sampled neighbours.
    """
    pairs = settled(edges.select("a", "b").filter("a <> b").distinct())
    share = min(1.0, batch_edges / max(1, pairs.count()))
    place = F.pmod(F.xxhash64("a", "b", "epoch", F.lit(config.seed)), F.lit(1 << 40)) / float(1 << 40)
    drawn = pairs.select("a", "b", F.explode(F.sequence(F.lit(1), F.lit(config.train_epochs))).alias("epoch")).filter(place < share)
    drawn = settled(drawn.withColumn("part", F.pmod(F.xxhash64("b", "a", "epoch"), F.lit(parts)).cast("int")))
    # Only what the drawn edges can reach is gathered.
    ends = drawn.select(F.explode(F.array("a", "b")).alias("a")).distinct()
    near = settled(_near(pairs, config.sage_neighbours))
    second = settled(near.join(ends, "a", "left_semi"))
    reach = ends.unionByName(second.select(F.col("b").alias("a"))).distinct()
    x = nodes.select("node", F.col("x").cast("array<double>").alias("x"))
    listed = near.join(reach, "a", "left_semi").join(x.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sort_array(F.collect_list("x")).alias("all"))
    first = x.join(reach.withColumnRenamed("a", "node"), "node", "left_semi").join(_means(listed, "m"), "node", "left")
    first = settled(first.select("node", F.concat("x", F.coalesce("m", "x")).alias("row")))
    around = second.join(first.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sort_array(F.collect_list("row")).alias("rows"))
    block = first.join(around, "node", "left").join(ends.withColumnRenamed("a", "node"), "node", "left_semi")
    block = settled(block.select("node", F.concat(F.array("row"), F.coalesce("rows", F.array("row"))).alias("block")))
    out = drawn
    for end in ("a", "b"):
        out = out.join(block.select(F.col("node").alias(end), F.col("block").alias(f"{end}_block")), end)
    out = out.select("epoch", "part", F.xxhash64("a", "b").alias("edge"), F.col("a_block").alias("a"), F.col("b_block").alias("b"))
    return settled(out.repartitionByRange("epoch", "part").sortWithinPartitions("epoch", "part"))


def _blocks(ends: list, width: int) -> tuple[np.ndarray, ...]:
    """Own rows, neighbours' rows and the neighbours' weights of some ends."""
    most = max(len(e) - 1 for e in ends)
    own, others, weight = np.zeros((len(ends), 2 * width)), np.zeros((len(ends), most, 2 * width)), np.zeros((len(ends), most))
    for i, e in enumerate(ends):
        own[i], others[i, : len(e) - 1], weight[i, : len(e) - 1] = e[0], e[1:], 1 / (len(e) - 1)
    return own, others, weight


def sage_gradient(params: dict[str, np.ndarray], a: list, b: list, negatives: int) -> tuple[dict[str, np.ndarray], float, int]:
    """Sums over a part's pairs of the gradients and of the logistic loss, and the number of pairs.

    Pairs are the edges, and each first end with the second ends of the ``negatives`` edges after it.
    """
    width, n = params["own0"].shape[0], len(a)
    own, others, weight = _blocks([*a, *b], width)
    x, m, xs, ms = own[:, :width], own[:, width:], others[..., :width], others[..., width:]
    h = np.maximum(x @ params["own0"] + m @ params["near0"], 0)
    hs = np.maximum(xs @ params["own0"] + ms @ params["near0"], 0)
    m1 = (hs * weight[..., None]).sum(1)
    z = h @ params["own1"] + m1 @ params["near1"]
    length = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    out, grad, loss, pairs = z / length, np.zeros_like(z), 0.0, 0
    for k in range(min(negatives, n - 1) + 1):
        first, second = np.arange(n), n + (np.arange(n) + k) % n
        score = (out[first] * out[second]).sum(1)
        slope = (1 / (1 + np.exp(-score)) - (k == 0))[:, None]
        loss += float(np.logaddexp(0, -score if k == 0 else score).sum())
        np.add.at(grad, first, slope * out[second])
        np.add.at(grad, second, slope * out[first])
        pairs += n
    gz = (grad - out * (grad * out).sum(1, keepdims=True)) / length
    gh = (gz @ params["own1"].T) * (h > 0)
    ghs = weight[..., None] * (gz @ params["near1"].T)[:, None, :] * (hs > 0)
    over = lambda v, g: np.einsum("nsi,nsj->ij", v, g)
    return {"own0": x.T @ gh + over(xs, ghs), "near0": m.T @ gh + over(ms, ghs), "own1": h.T @ gz, "near1": m1.T @ gz}, loss, pairs


def _part_sums(params: dict[str, np.ndarray], negatives: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("edge")
        grads, loss, n = sage_gradient(params, rows.column("a").to_pylist(), rows.column("b").to_pylist(), negatives)
        flat = np.concatenate([grads[k].ravel() for k in sorted(grads)]).tobytes()
        return pa.table({"part": rows.column("part").slice(0, 1), "n": pa.array([n], pa.int64()), "loss": pa.array([loss]), "grads": pa.array([flat], pa.binary())})

    return run


def train_on(batches: DataFrame, width: int, config: EngineConfig = DEFAULT) -> tuple[dict[str, np.ndarray], list[float]]:
    """Weights after an Adam step for each epoch of ``minibatches``, and the mean loss of each epoch.

    The parts of a batch are tasks, which send back one row of sums each.
    """
    params = Sage((width, *config.sage_dims[1:]), config.seed).params
    adam = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in params.items()}
    order, losses = sorted(params), []
    for epoch in range(1, config.train_epochs + 1):
        sums = batches.filter(F.col("epoch") == epoch).groupBy("part").applyInArrow(_part_sums(params, config.negatives), "part int, n bigint, loss double, grads binary").collect()  # a row for each part
        if not sums:
            continue
        sums.sort(key=lambda r: r["part"])
        total, at = sum(r["n"] for r in sums), 0
        flat = sum(np.frombuffer(r["grads"]) for r in sums) / total
        losses.append(sum(r["loss"] for r in sums) / total)
        params = dict(params)
        for k in order:
            g = flat[at : at + params[k].size].reshape(params[k].shape)
            at += params[k].size
            one, two = adam[k]
            one += 0.1 * (g - one)
            two += 0.001 * (g * g - two)
            params[k] = params[k] - config.learning_rate * (one / (1 - 0.9**epoch)) / (np.sqrt(two / (1 - 0.999**epoch)) + 1e-8)
    return params, losses


def sage(nodes: DataFrame, edges: DataFrame, config: EngineConfig = DEFAULT, params: dict[str, np.ndarray] | None = None) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """(node, embedding) for (node, x) features and (a, b) edges, and the weights, trained unless given."""
    if params is None:
        one = nodes.select("x").first()
        width = len(one["x"]) if one else config.sage_dims[0]
        params, _ = train_on(minibatches(nodes, edges, config), width, config)
    return infer_sage(nodes, edges, params, config.sage_neighbours), params


def params_table(spark: SparkSession, model: str, params: dict[str, np.ndarray]) -> DataFrame:
    return spark.createDataFrame([(model, k, i, row.tolist()) for k, v in params.items() for i, row in enumerate(np.atleast_2d(v))], "model string, param string, row int, value array<double>")


def load_params(table: DataFrame, model: str) -> dict[str, np.ndarray] | None:
    rows = table.filter(F.col("model") == model).orderBy("param", "row").collect()
    names = dict.fromkeys(r["param"] for r in rows)
    return {n: np.array([r["value"] for r in rows if r["param"] == n]) for n in names} or None

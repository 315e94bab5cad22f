"""Communities of the entity graph.

Connected components come from distributed label joins. Each component is then partitioned on its own: nodes move to the
neighbouring community of the largest gain in modularity (with a resolution); communities are refined into well-connected
subsets, which are the nodes of the next graph and start in the communities they come from; and so on until nothing moves. A component of up to
LOCAL_EDGES edges is one task; the moves and refinements of a larger one are joins and aggregates over all its nodes.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.config import DEFAULT, EngineConfig
from quillgraph.sources.catalog import settled

#: Edges of a component that one task works on, and most rounds of a step over a larger one.
LOCAL_EDGES = 2_000_000
PASSES, MOVE_ROUNDS, REFINE_ROUNDS = 12, 24, 12


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, weight) of 'name::type' ends with a < b; parallel edges stay, self-loops go."""
    src, dst = F.concat_ws("::", "src_name", "src_type"), F.concat_ws("::", "dst_name", "dst_type")
    return edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"), "weight").filter("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that can be reached. Labels halve their distance in each round by jumping."""
    both = settled(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settled(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        new = settled(step.join(jump, F.col("label") == F.col("at")).select("node", "old", F.least("label", "far").alias("label")))
        moved = new.filter("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels.withColumnRenamed("label", "component")


def _move(near: list[dict[int, float]], degree: np.ndarray, group: np.ndarray, total: float, resolution: float, rng) -> np.ndarray:
    """Moves single nodes to the neighbouring group of the largest gain until none gains."""
    group, mass = group.copy(), np.bincount(group, degree, len(near))
    queue, waiting = deque(rng.permutation(len(near)).tolist()), np.ones(len(near), bool)
    while queue:
        i = queue.popleft()
        waiting[i] = False
        links: dict[int, float] = {}
        for j, v in near[i].items():
            links[group[j]] = links.get(group[j], 0.0) + v
        old = group[i]
        mass[old] -= degree[i]
        gain = {g: v - resolution * degree[i] * mass[g] / total for g, v in links.items()}
        gain.setdefault(old, -resolution * degree[i] * mass[old] / total)
        best = max(sorted(gain), key=lambda g: (gain[g] > gain[old] + 1e-12, gain[g]))
        if gain[best] <= gain[old] + 1e-12:
            best = old
        group[i] = best
        mass[best] += degree[i]
        if best != old:
            for j in near[i]:
                if group[j] != best and not waiting[j]:
                    waiting[j] = True
                    queue.append(j)
    return group


def _refine(near: list[dict[int, float]], degree: np.ndarray, group: np.ndarray, total: float, resolution: float, rng) -> np.ndarray:
    """Well-connected subsets of the groups.

    Nodes start alone. One that is well connected to the rest of its group joins, while it is still alone, the subset of the
    largest gain that is well connected too; so subsets are connected.
    """
    n = len(near)
    whole, part, mass, size = np.bincount(group, degree, n), np.arange(n), degree.copy(), np.ones(n, int)
    cut = np.array([sum(v for j, v in links.items() if group[j] == group[i]) for i, links in enumerate(near)])  # to the rest of the group
    firm = lambda s, g: cut[s] >= resolution * mass[s] * (whole[g] - mass[s]) / total - 1e-12
    for i in rng.permutation(n).tolist():
        if size[part[i]] > 1 or part[i] != i or not firm(i, group[i]):
            continue
        links: dict[int, float] = {}
        for j, v in near[i].items():
            if group[j] == group[i]:
                links[part[j]] = links.get(part[j], 0.0) + v
        gain = {s: v - resolution * degree[i] * mass[s] / total for s, v in links.items() if s != i and firm(s, group[i])}
        best = max(sorted(gain), key=gain.get, default=None)
        if best is None or gain[best] <= 1e-12:
            continue
        cut[best] += cut[i] - 2 * links[best]
        mass[best] += degree[i]
        size[best] += 1
        size[i] = 0
        part[i] = best
    return part


def partition(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float, seed: int, degree: np.ndarray | None = None, total: float | None = None, group: np.ndarray | None = None) -> np.ndarray:
    """Community of each of ``n`` nodes, numbered by first appearance: local moves, refinement, aggregation, and again.

    Passes over the whole graph, each from the communities of the last, go on while they raise the modularity, PASSES at most.
    ``degree``, ``total`` (twice the weight of all edges) and a first ``group`` are given for a graph of subsets.
    """
    rng = np.random.default_rng(seed)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for x, y, v in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
        near[x][y] = near[x].get(y, 0.0) + v
        near[y][x] = near[y].get(x, 0.0) + v
    total = 2 * float(w.sum()) if total is None else total
    if total <= 0:
        return np.arange(n)
    degree = np.array([sum(x.values()) for x in near]) if degree is None else degree.astype(float)
    group = np.arange(n) if group is None else np.unique(group, return_inverse=True)[1]
    label, best = group, -np.inf
    for _ in range(PASSES):
        new = _pass(near, degree, label, total, resolution, rng)
        inside = np.bincount(new[a], np.where(new[a] == new[b], w, 0.0)).sum() * 2
        score = inside / total - resolution * ((np.bincount(new, degree) / total) ** 2).sum()
        if score <= best + 1e-9:
            break
        label, best = new, score
    seen = {g: k for k, g in enumerate(dict.fromkeys(label.tolist()))}
    return np.array([seen[g] for g in label.tolist()])


def _pass(near: list[dict[int, float]], degree: np.ndarray, group: np.ndarray, total: float, resolution: float, rng) -> np.ndarray:
    base, at = near, np.arange(len(near))  # the node of the present graph that each first node is in
    group = np.unique(group, return_inverse=True)[1]
    while True:
        group = _move(near, degree, group, total, resolution, rng)
        count, groups = len(near), len(np.unique(group))
        if groups == count:
            break
        part = _refine(near, degree, group, total, resolution, rng)
        if len(np.unique(part)) == count:  # nothing to aggregate but the groups themselves
            part = _connected(near, group)
            if len(np.unique(part)) == count:
                break
        _, first, part = np.unique(part, return_index=True, return_inverse=True)
        merged: list[dict[int, float]] = [{} for _ in first]
        for i, links in enumerate(near):
            for j, v in links.items():
                if part[i] != part[j]:
                    merged[part[i]][int(part[j])] = merged[part[i]].get(int(part[j]), 0.0) + v
        near, degree, at = merged, np.bincount(part, degree), part[at]
        group = np.unique(group[first], return_inverse=True)[1]
    return _connected(base, group[at])


def _connected(near: list[dict[int, float]], group: np.ndarray) -> np.ndarray:
    """Split groups into their connected parts."""
    part = np.full(len(near), -1)
    n = 0
    for i in range(len(near)):
        if part[i] < 0:
            part[i], todo = n, [i]
            while todo:
                for j in near[todo.pop()]:
                    if part[j] < 0 and group[j] == group[i]:
                        part[j] = n
                        todo.append(j)
            n += 1
    return part


def modularity(labels: dict, edges: list[tuple], resolution: float = 1.0) -> float:
    total = sum(w for *_, w in edges)
    inside: dict = {}
    degree: dict = {}
    for a, b, w in edges:
        degree[labels[a]] = degree.get(labels[a], 0) + w
        degree[labels[b]] = degree.get(labels[b], 0) + w
        if labels[a] == labels[b]:
            inside[labels[a]] = inside.get(labels[a], 0) + w
    return sum(inside.get(c, 0) / total - resolution * (d / (2 * total)) ** 2 for c, d in degree.items())


# Components of many edges

def _gains(nodes: DataFrame, edges: DataFrame, total: float, resolution: float, own: str, mass: DataFrame) -> DataFrame:
    """(node, to, link, gain) of joining each neighbouring ``own`` (a community or a subset), one's own without oneself included."""
    there = nodes.select(F.col("node").alias("dst"), F.col(own).alias("to"))
    links = edges.join(there, "dst").groupBy(F.col("src").alias("node"), "to").agg(F.sum("w").alias("link"))
    links = links.unionByName(nodes.select("node", F.col(own).alias("to"), F.lit(0.0).alias("link"))).groupBy("node", "to").agg(F.sum("link").alias("link"))
    known = links.join(nodes.select("node", F.col(own).alias("here"), "degree", "comm"), "node").join(mass, "to")
    besides = F.col("mass") - F.when(F.col("to") == F.col("here"), F.col("degree")).otherwise(0.0)
    return known.withColumn("gain", F.col("link") - F.lit(resolution / total) * F.col("degree") * besides)


def _turn(column: str, t: int, seed: int):
    return F.pmod(F.xxhash64(column, F.lit(t), F.lit(seed)), F.lit(2))


def _spread_moves(nodes: DataFrame, edges: DataFrame, total: float, resolution: float, seed: int) -> DataFrame:
    """Local moves in rounds: half of the nodes, chosen by hash, may move at a time. The partition of the highest modularity counts."""
    best, most, still = nodes, None, 0
    for t in range(MOVE_ROUNDS):
        mass = nodes.groupBy(F.col("comm").alias("to")).agg(F.sum("degree").alias("mass"), F.count(F.lit(1)).alias("size"))
        gains = settled(_gains(nodes, edges, total, resolution, "comm", mass))
        inside = gains.filter("to = here").agg(F.sum("link")).first()[0]
        score = inside / total - resolution * mass.agg(F.sum((F.col("mass") / total) ** 2)).first()[0]
        if most is None or score > most + 1e-9:
            best, most, still = nodes, score, 0
        else:
            still += 1
        first = gains.groupBy("node").agg(F.max_by(F.struct("to", "gain", "size"), F.struct("gain", F.col("to") == F.col("here"))).alias("best"), F.max(F.when(F.col("to") == F.col("here"), F.struct("gain", "size"))).alias("now"))
        swap = (F.col("best.size") == 1) & (F.col("now.size") == 1) & (F.col("best.to") > F.col("comm"))
        moves = (F.col("best.gain") > F.col("now.gain") + 1e-12) & (_turn("node", t, seed) == 0) & ~swap
        new = settled(nodes.join(first, "node").select("node", F.when(moves, F.col("best.to")).otherwise(F.col("comm")).alias("comm"), "degree", moves.alias("moved")))
        moved = new.filter("moved").limit(1).count()
        nodes = new.drop("moved")
        if still >= 3 or not moved and t % 2:
            break
    return best


def _spread_refine(nodes: DataFrame, edges: DataFrame, total: float, resolution: float, seed: int) -> DataFrame:
    """``nodes`` with ``sub``, the well-connected subset; in each round single nodes of one half join subsets of the other."""
    whole = nodes.groupBy("comm").agg(F.sum("degree").alias("whole"))
    comm = nodes.select(F.col("node").alias("dst"), F.col("comm").alias("there"))
    inner = edges.join(nodes.select(F.col("node").alias("src"), "comm"), "src").join(comm, "dst").filter("comm = there").select("src", "dst", "w")
    inner = settled(inner)
    now = settled(nodes.withColumn("sub", F.col("node")))
    for t in range(REFINE_ROUNDS):
        here = now.select(F.col("node").alias("src"), F.col("sub").alias("s"))
        there = now.select(F.col("node").alias("dst"), F.col("sub").alias("d"))
        cut = inner.join(here, "src").join(there, "dst").groupBy("s").agg(F.sum(F.when(F.col("s") != F.col("d"), F.col("w")).otherwise(0.0)).alias("cut"))
        subs = now.groupBy(F.col("sub").alias("to"), "comm").agg(F.sum("degree").alias("mass"), F.count(F.lit(1)).alias("size"))
        subs = subs.join(whole, "comm").join(cut.withColumnRenamed("s", "to"), "to")
        firm = F.col("cut") >= F.lit(resolution / total) * F.col("mass") * (F.col("whole") - F.col("mass")) - 1e-12
        subs = settled(subs.withColumn("firm", firm).select("to", "mass", "size", "firm"))
        alone = subs.filter("firm and size = 1").select(F.col("to").alias("node"))
        gains = _gains(now, inner, total, resolution, "sub", subs).join(alone, "node", "left_semi")
        gains = gains.filter(F.col("firm") & (F.col("to") != F.col("here")) & (F.col("gain") > 1e-12) & (_turn("node", t, seed) == 0) & (_turn("to", t, seed) == 1))
        joins = gains.groupBy("node").agg(F.max_by("to", F.struct("gain", "to")).alias("into"))
        new = settled(now.join(joins, "node", "left").select("node", "comm", "degree", F.coalesce("into", "sub").alias("sub"), F.col("into").isNotNull().alias("moved")))
        moved = new.filter("moved").limit(1).count()
        now = new.drop("moved")
        if not moved and t % 4 == 3:
            break
    return now


def spread(edges: DataFrame, config: EngineConfig = DEFAULT, local_edges: int | None = None) -> DataFrame:
    """(node, head) of one large component's (a, b, weight) edges, worked on by many tasks.

    Local moves and refinement go in rounds over all nodes; the graph of subsets follows, until it has ``local_edges`` edges or no
    longer shrinks. Then a single task ends the work. A community's head is its least node.
    """
    resolution, seed, limit = config.community_resolution, config.seed, LOCAL_EDGES if local_edges is None else local_edges
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("weight").alias("w")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), F.col("weight").alias("w")))
    both = base = settled(both.groupBy("src", "dst").agg(F.sum("w").alias("w")))
    total = both.agg(F.sum("w")).first()[0]
    nodes = settled(both.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("degree")).select("node", F.col("node").alias("comm"), "degree"))
    at = nodes.select("node", F.col("node").alias("own"))
    count, size = nodes.count(), both.count()
    while size > 2 * limit:
        nodes = _spread_moves(nodes, both, total, resolution, seed)
        now = _spread_refine(nodes, both, total, resolution, seed)
        sub = now.select("node", "sub")
        at = settled(at.join(sub.withColumnRenamed("node", "own"), "own").select("node", F.col("sub").alias("own")))
        both = both.join(sub.select(F.col("node").alias("src"), F.col("sub").alias("s")), "src").join(sub.select(F.col("node").alias("dst"), F.col("sub").alias("d")), "dst")
        both = settled(both.filter("s <> d").groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum("w").alias("w")))
        nodes = settled(now.groupBy(F.col("sub").alias("node")).agg(F.min("comm").alias("comm"), F.sum("degree").alias("degree")))
        before, count, size = count, nodes.count(), both.count()
        if count > 0.95 * before:
            break
    if size <= 2 * limit:
        nodes = _end(nodes, both, total, resolution, seed)
    label = settled(at.join(nodes.select(F.col("node").alias("own"), "comm"), "own").select("node", "comm"))
    # A move may have cut a community in two.
    inside = base.join(label.withColumnRenamed("node", "src"), "src").join(label.select(F.col("node").alias("dst"), F.col("comm").alias("there")), "dst").filter("comm = there")
    joined = components(inside.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return label.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("head"))


def _end(nodes: DataFrame, both: DataFrame, total: float, resolution: float, seed: int) -> DataFrame:
    kind = nodes.schema["node"].dataType.simpleString()

    def run(key, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        own, links = own.sort_values("node").reset_index(drop=True), links.sort_values(["src", "dst"])
        place = {x: i for i, x in enumerate(own["node"])}
        once = links[links["src"] < links["dst"]]
        a, b = (once[c].map(place).to_numpy(int) for c in ("src", "dst"))
        group = partition(len(own), a, b, once["w"].to_numpy(float), resolution, seed, own["degree"].to_numpy(float), total, own["comm"].astype("category").cat.codes.to_numpy())
        return pd.DataFrame({"node": own["node"], "comm": [own["node"][k] for k in np.unique(group, return_index=True)[1][group]], "degree": own["degree"]})

    one = F.lit(0).alias("one")
    return settled(nodes.select("*", one).groupBy("one").cogroup(both.select("*", one).groupBy("one")).applyInPandas(run, f"node {kind}, comm {kind}, degree double"))


def numbered(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with ``number`` from 0 in the given order, by sorted ranges and the number of rows before each."""
    turn = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__turn", turn))
    before, offsets = 0, []
    for r in ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect():  # a row for each partition
        offsets.append((r["__part"], before))
        before += r["n"]
    sent = rows.sparkSession.createDataFrame(offsets, "__part int, __before bigint")
    return ranged.join(F.broadcast(sent), "__part").withColumn("number", F.col("__before") + F.col("__turn")).drop("__part", "__before", "__turn")


def detect(edges: DataFrame, nodes: DataFrame | None = None, config: EngineConfig = DEFAULT, local_edges: int | None = None) -> DataFrame:
    """(node, community_id) from ``undirected`` edges; ids number communities by size, then least node.

    Components of up to ``local_edges`` edges are a task each, larger ones are worked on by all tasks together.
    ``nodes`` (node) adds nodes without edges as communities of one.
    """
    resolution, seed, limit = config.community_resolution, config.seed, LOCAL_EDGES if local_edges is None else local_edges
    part = components(edges)
    placed = settled(edges.join(part, F.col("a") == F.col("node")).select("component", "a", "b", "weight"))
    large = [r["component"] for r in placed.groupBy("component").count().filter(F.col("count") > limit).collect()]  # edges / limit rows at most

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["a", "b", "weight"], kind="stable")
        names, index = np.unique(np.concatenate([rows["a"], rows["b"]]).astype(str), return_inverse=True)
        own = partition(len(names), index[: len(rows)], index[len(rows) :], rows["weight"].to_numpy(float), resolution, seed)
        least = {g: min(names[own == g].tolist()) for g in np.unique(own)}
        return pd.DataFrame({"node": names, "head": [least[g] for g in own]})

    found = placed.filter(~F.col("component").isin(large)).groupBy("component").applyInPandas(run, "node string, head string")
    for component in large:
        found = found.unionByName(spread(placed.filter(F.col("component") == component), config, limit))
    if nodes is not None:
        alone = nodes.select("node").join(found.select("node"), "node", "left_anti")
        found = found.unionByName(alone.select("node", F.col("node").alias("head")))
    found = settled(found)
    sizes = found.groupBy("head").agg(F.count(F.lit(1)).alias("size"))
    ids = numbered(sizes, F.desc("size"), F.asc("head")).select("head", F.col("number").cast("int").alias("community_id"))
    return found.join(ids, "head").select("node", "community_id")

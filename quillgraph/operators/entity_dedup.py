"""Three tiers of entity merging: equal names in the cluster, then similar names and similar vectors within a type.

The two similarity tiers are greedy and depend on order (``first_seq``): an entity joins the first group whose first member,
its leader, is similar enough, or else leads a group. Both are distributed in the same way:

* Equal keys (names with sorted words; vectors of length 1) are one node, for they share every similarity.
* Similar pairs come from an index and are verified once: for names, prefixes of their q-grams, rarest first (two names
  that are similar enough share a gram of these prefixes), then lengths, counts of characters and the longest
  common subsequence; for vectors, cells whose angle bounds allow the cosine.
* Leaders are found in rounds. A node without an earlier neighbour that is left leads; its later neighbours are
  members and go; what remains goes into the next round. Every round is written out. There are as many rounds
  as leaders wait for each other in a chain, few unless names form long chains of neighbours. In the end a member joins
  its earliest neighbour among the leaders, which is what the sequential rule gives.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.config import DEFAULT, EngineConfig
from quillgraph.operators import vector_index
from quillgraph.operators.graph import _merged_maps, dedup_entities
from quillgraph.sources.catalog import settled

#: Pairs of names of this length and more are found by pairs of characters, others by single ones.
LONG = 12


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one integer as the row of the table."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def sorted_words(name: str) -> str:
    return " ".join(sorted(name.split()))


def token_sort_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (lengths) of the names with their words sorted."""
    x, y = sorted_words(a), sorted_words(b)
    return 100.0 if not x and not y else 100.0 * 2 * common_subsequence(x, y) / (len(x) + len(y))


# Leaders

def leaders(edges: DataFrame) -> DataFrame:
    """(node, head) of each member, from distinct pairs (lo, hi) of similar nodes with ``lo`` the earlier in the nodes' own order."""
    left, members = edges, None
    while left.limit(1).count():
        first = left.select("lo").distinct().join(left.select(F.col("hi").alias("lo")).distinct(), "lo", "left_anti")
        more = settled(left.join(first, "lo", "left_semi").select("hi").distinct())
        members = more if members is None else members.unionByName(more)
        left = left.join(more, "hi", "left_anti").join(more.withColumnRenamed("hi", "lo"), "lo", "left_anti")
        left = settled(left.select("lo", "hi"))
    if members is None:
        return edges.select(F.col("hi").alias("node"), F.col("lo").alias("head"))
    led = edges.join(members.withColumnRenamed("hi", "lo"), "lo", "left_anti")
    return led.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("head"))


def _merged(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """One row for each ``head``: that of the highest confidence, the first of equals, with all properties and names."""
    kept = [c for c in entities.columns if c not in ("type", "properties", "first_seq", "names")]
    best = F.max_by(F.struct(*kept), F.struct(F.col("confidence"), -F.col("first_seq"))).alias("best")
    own = rows.groupBy("type", "head").agg(best, F.collect_list(F.struct(F.col("first_seq").alias("seq"), "properties", "names")).alias("all"), F.min("first_seq").alias("first_seq"))
    in_order = F.array_sort("all", lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0))
    made = {"type": F.col("type"), "first_seq": F.col("first_seq"), "properties": _merged_maps("all"), "names": F.flatten(F.transform(in_order, lambda r: r["names"]))}
    return own.select(*[(made[c] if c in made else F.col("best")[c]).alias(c) for c in entities.columns])


# Similar names

def _limits(limit: float) -> tuple[float, float, float]:
    """For a name of n characters: the least n x of a similar one, and how many single and paired characters (n x - 1) they share at least.

    A subsequence of c characters that is common to a and b spares c of the single characters, and all pairs of a but two
    for each character of a and one for each of b that it leaves out: 3 c - len(a) - len(b) - 1.
    """
    share = min(limit, 100.0) / 100
    short = share / (2 - share)
    return short, share * (1 + short) / 2, (1 + short) * (1.5 * share - 1)


def grams(name: str, limit: float) -> list[tuple[str, int]]:
    """(gram, length of the prefix) of a name: its numbered characters if a short name may be similar, its numbered pairs if a long one may."""
    short, single, paired = _limits(limit)
    n, out = len(name), []
    pairs = paired * LONG - 1 >= 1
    for size, wanted, share, less in ((1, not pairs or n * short < LONG, single, 0), (2, pairs and n >= LONG, paired, 1)):
        if wanted and n >= size:
            prefix = (n - size + 1) - int(np.ceil(share * n - less - 1e-9)) + 1
            seen: Counter = Counter()
            for i in range(n - size + 1):
                g = name[i : i + size]
                seen[g] += 1
                out.append((f"{size}{g}{seen[g]}", min(prefix, n - size + 1)))
    return out


def _gram_rows(limit: float):
    def run(batches):
        for batch in batches:
            rows = [(i, g, p) for i, key in enumerate(batch.column("key").to_pylist()) for g, p in grams(key, limit)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("type").take(at), batch.column("seq").take(at), batch.column("key").take(at), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())], names=["type", "seq", "key", "gram", "prefix"])

    return run


def _verified(limit: float):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                need = limit * (len(a) + len(b)) / 200 - 1e-9
                keep.append((Counter(a) & Counter(b)).total() >= need and 100.0 * 2 * common_subsequence(a, b) / (len(a) + len(b)) >= limit)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def similar_names(nodes: DataFrame, limit: float) -> DataFrame:
    """(lo, hi) of distinct (type, seq, key) nodes whose keys are similar; lo has the lower (seq, key)."""
    kind = nodes.schema["seq"].dataType.simpleString()
    own = settled(nodes.mapInArrow(_gram_rows(limit), f"type string, seq {kind}, key string, gram string, prefix int"))
    often = own.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    ranked = own.join(often, "gram").withColumn("scheme", F.substring("gram", 1, 1)).groupBy("type", "seq", "key", "scheme", "prefix").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("grams"))
    lists = settled(ranked.select("type", "seq", "key", F.char_length("key").alias("n"), F.explode(F.slice("grams", 1, F.col("prefix"))["gram"]).alias("gram")))
    short = _limits(limit)[0]
    a, b = lists.alias("a"), lists.alias("b")
    near = (F.col("a.n") + 1e-9 >= F.col("b.n") * short) & (F.col("b.n") + 1e-9 >= F.col("a.n") * short)
    earlier = (F.col("a.seq") < F.col("b.seq")) | ((F.col("a.seq") == F.col("b.seq")) & (F.col("a.key") < F.col("b.key")))
    pairs = a.join(b, (F.col("a.type").eqNullSafe(F.col("b.type"))) & (F.col("a.gram") == F.col("b.gram")) & near & earlier)
    pairs = pairs.select(F.col("a.type").alias("type"), F.col("a.seq").alias("s"), F.col("a.key").alias("a"), F.col("b.seq").alias("t"), F.col("b.key").alias("b")).distinct()
    found = pairs.mapInArrow(_verified(limit), pairs.schema)
    node = lambda seq, key: F.struct("type", F.col(seq).alias("seq"), F.col(key).alias("key"))
    return settled(found.select(node("s", "a").alias("lo"), node("t", "b").alias("hi")))


def fuzzy_tier(entities: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    if config.fuzzy_threshold <= 0:
        raise ValueError("fuzzy_threshold must be positive")
    words = F.array_join(F.array_sort(F.filter(F.split("norm_name", r"\s+"), lambda w: w != "")), " ")
    own = settled(entities.withColumn("__key", words))
    nodes = own.groupBy("type", F.col("__key").alias("key")).agg(F.min("first_seq").alias("seq")).select("type", "seq", "key")
    found = leaders(similar_names(nodes.filter("key <> ''"), config.fuzzy_threshold))
    heads = nodes.withColumn("node", F.struct("type", "seq", "key")).join(found, "node", "left").select(F.col("type").alias("__type"), F.col("key").alias("__key"), F.coalesce("head", "node").alias("head"))
    return _merged(own.join(heads, F.col("type").eqNullSafe(F.col("__type")) & (own["__key"] == heads["__key"])), entities)


def vector_tier(entities: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Needs a ``vector`` column; rows without one, or with one of length 0, stay alone."""
    length = F.sqrt(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    own = settled(entities.withColumn("__unit", F.when(length > 0, F.transform(F.col("vector").cast("array<double>"), lambda x: F.round(x / length, 12)))).withColumn("__type", F.coalesce("type", F.lit(""))))
    nodes = own.filter("__unit is not null").groupBy("__type", F.col("__unit").alias("unit")).agg(F.min("first_seq").alias("seq"))
    nodes = settled(nodes.withColumn("id", F.to_json(F.struct("__type", "seq"))))
    index = vector_index.build(nodes, "id", "unit", same="__type")
    close = vector_index.within(index, nodes.select(F.col("id").alias("query_id"), F.col("unit").alias("vec"), "__type"), config.entity_cosine - 5e-13)
    place = lambda c: F.from_json(c, f"__type string, seq {own.schema['first_seq'].dataType.simpleString()}")
    pairs = close.select(place("query_id").alias("lo"), place("id").alias("hi")).filter("lo.seq < hi.seq")
    found = leaders(settled(pairs))
    node = F.struct("__type", "seq")
    heads = nodes.withColumn("node", node).join(found, "node", "left").select(F.col("__type").alias("t"), F.col("unit").alias("u"), F.coalesce("head", "node").alias("head"))
    joined = own.join(heads, (own["__type"] == heads["t"]) & (own["__unit"] == heads["u"]), "left")
    alone = F.struct(F.col("__type").alias("__type"), F.col("first_seq").alias("seq"))
    return _merged(joined.withColumn("head", F.coalesce("head", alone)), entities)


def dedup_enhanced(entities: DataFrame, embed: Callable | None = None, config: EngineConfig = DEFAULT, fuzzy: bool = True) -> DataFrame:
    """Exact, fuzzy and vector tiers. ``embed`` maps a name column to a vector column; without it that tier is skipped.

    ``names`` lists the spellings that were merged, and can serve as an alias table.
    """
    own = dedup_entities(entities).withColumn("names", F.array("name"))
    if fuzzy:
        own = fuzzy_tier(own, config)
    if embed is not None:
        own = vector_tier(own.withColumn("vector", embed(F.concat("name", F.lit(" ("), "type", F.lit(")")))), config).drop("vector")
    return own

"""Helpers shared by the text-preparation operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a local master without one."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        sc.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which ends its lineage.

    The files outlive lost executors, and the JVM deletes them when the session's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillgraph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def numbered_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with one row for each doc_id.

    A null text counts as empty. A row without doc_id can't be named in a result and is left out.
    Rows that share a doc_id are one document, whose text is the least of their texts. Other
    columns are not looked at.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    own = own.filter(F.col("doc_id").isNotNull())
    repeated = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    return own.groupBy("doc_id").agg(F.min("text").alias("text")) if repeated else own


def sheltered(docs: DataFrame, *own: str) -> DataFrame:
    """The columns ``own`` and a struct ``rest`` of all others, so helper columns can't clash with those."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return docs.select(*own, F.struct(*(rest or [F.lit(0).alias("none")])).alias("rest"))


def restored(rows: DataFrame, docs: DataFrame, *own: str) -> DataFrame:
    """The rows of a sheltered frame with the columns of ``docs`` again."""
    return rows.select(*[F.col(c) if c in own else F.col("rest").getField(c).alias(c) for c in docs.columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _are_stars(pairs: DataFrame) -> bool:
    """Whether each ``u`` has one ``v``, which is nobody's ``u``: then every pair names a node and its component."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).filter("up + root > 1").limit(1).count()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge.

    Alternates the large-star and small-star steps, both as aggregate and join, until only stars are
    left. Each round is written out, so a lost executor costs one round.
    """
    pairs = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    while not _are_stars(pairs):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        pairs = cut(small.filter("u <> v").distinct())
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cut(pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots))


def merge_components(found: DataFrame, edges: DataFrame) -> DataFrame:
    """``found`` (node, component) after ``edges`` (a, b) more; only the components that they name are worked on."""
    own = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
    between = edges.select("a", "b").join(own("a"), "a", "left").join(own("b"), "b", "left")
    merged = connected_components(between.select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b")))
    into = merged.select(F.col("node").alias("component"), F.col("component").alias("into"))
    old = found.join(into, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    return cut(old.unionByName(merged.join(found, "node", "left_anti")))


def first_by_hash(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows of each group whose key's hash comes first; keys are distinct within a group.

    Groups are few (a row for each is broadcast). Of a large one, only rows with a hash in the first 4 ``n``-th of
    its size are dealt out: some 4 ``n`` rows, and fewer than ``n`` with a chance below 1e-100.
    """
    place = F.xxhash64(key)
    size = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__size"))
    near = rows.withColumn("__place", place).join(F.broadcast(size), group).filter((F.col("__place") / float(2**64) + 0.5) * F.col("__size") <= 4 * max(n, 100))
    turn = F.row_number().over(Window.partitionBy(group).orderBy("__place", key))
    return near.withColumn("__turn", turn).filter(F.col("__turn") <= n).drop("__turn", "__place", "__size")


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)

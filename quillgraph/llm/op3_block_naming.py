"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of BLOCK_CHARS. All distinct blocks of the corpus are sorted and
numbered; then adjacent pairs of numbers are sorted and numbered in turn, level by level, until each
document has one number. Two documents have the same level and number if and only if their texts are
equal: a name stands for one block or one pair, so nothing rests on a hash.

Texts leave the scan once, to be made distinct (after a partial aggregation, which folds copies early).
Blocks are then known by their 64-bit hash and, among blocks that share one, by their rank in text order;
so joins carry 12 bytes and not the block. Joins on names of many copies are plain sort-merge joins,
whose large keys adaptive execution splits.

Normalisation replaces each run of [\\x20\\x09-\\x0D] by one space. Defined cases: a null text counts as
empty, and all empty texts are equal; rows that share a doc_id are one document with the least text;
a null doc_id is left out; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm import common

BLOCK_CHARS = 4096
SPACES = r"[\x20\x09-\x0D]+"


def _named(keys: DataFrame, *columns: str) -> DataFrame:
    """The distinct rows of ``columns``, sorted, with ascending numbers as ``name``."""
    spark = keys.sparkSession
    ordered = keys.select(*columns).distinct().repartitionByRange(common.partitions(spark), *columns).sortWithinPartitions(*columns)
    return common.cut(ordered.select(*columns, F.monotonically_increasing_id().alias("name")))


def _blocks(own: DataFrame, block_chars: int) -> DataFrame:
    cut = F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    return own.withColumn("blocks", F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(cut))


def identities(docs: DataFrame, block_chars: int = BLOCK_CHARS, hashed=F.xxhash64) -> tuple[DataFrame, DataFrame]:
    """(doc_id, level, name) with equal (level, name) for equal texts, and (doc_id, text_sha256)."""
    own = common.numbered_documents(docs).select("doc_id", F.regexp_replace("text", SPACES, " ").alias("norm"))
    cut = _blocks(own, block_chars)
    table = common.cut(cut.select("doc_id", common.sha256_text(F.col("norm")).alias("text_sha256"), F.transform("blocks", lambda b: hashed(b)).alias("hashes")))
    blocks = cut.select(F.explode("blocks").alias("block")).select(hashed("block").alias("h"), "block")
    distinct = blocks.groupBy("h", "block").agg(F.lit(1).alias("one"))
    shared = common.cut(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("h"))
    places = table.select("doc_id", F.posexplode("hashes").alias("i", "h"), F.size("hashes").alias("n"))
    if shared.limit(1).count():  # blocks that share a hash are told apart by their text
        in_doc = cut.select("doc_id", F.posexplode("blocks").alias("i", "block")).withColumn("h", hashed("block")).join(shared, "h", "left_semi")
        rank = in_doc.select("h", "block").distinct().withColumn("turn", F.row_number().over(Window.partitionBy("h").orderBy("block")))
        turns = in_doc.join(rank, ["h", "block"]).select("doc_id", "i", "turn")
        places = places.join(turns, ["doc_id", "i"], "left").withColumn("turn", F.coalesce("turn", F.lit(0)))
    else:
        places = places.withColumn("turn", F.lit(0))
    named = _named(places, "h", "turn")
    level = 0
    rows = common.cut(places.join(named, ["h", "turn"]).select("doc_id", "i", "n", "name"))
    done = rows.filter("n = 1").select("doc_id", F.lit(0).alias("level"), "name")
    rows = rows.filter("n > 1")
    most = table.agg(F.max(F.size("hashes"))).first()[0] or 0
    while most > 1:
        level, most = level + 1, (most + 1) // 2
        pair = rows.groupBy("doc_id", F.expr("i div 2").cast("int").alias("i"), F.expr("(n + 1) div 2").cast("int").alias("n")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")
        )
        pair = common.cut(pair)
        rows = common.cut(pair.join(_named(pair, "a", "b"), ["a", "b"]).select("doc_id", "i", "n", "name"))
        done = done.unionByName(rows.filter("n = 1").select("doc_id", F.lit(level).alias("level"), "name"))
        rows = rows.filter("n > 1")
    return done, table.select("doc_id", "text_sha256")


def exact_groups(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): the least doc_id of each group stays."""
    done, sha = identities(docs, block_chars)
    done = common.cut(done)
    # Written out, so that the join is one of plain exchanges, whose large keys can be split.
    groups = common.cut(done.groupBy("level", "name").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    return (
        done.join(groups, ["level", "name"])
        .join(sha, "doc_id")
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""

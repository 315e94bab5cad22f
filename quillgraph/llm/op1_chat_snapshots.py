"""Chat formatting with cumulative-snapshot collapse.

A chat that is logged again after each turn leaves conversations that are prefixes of later ones. Every
turn gets a rolling hash of the turns up to it: the running sums, over the conversation, of hashes of
(position, role, text), in four lanes of 32 bits. A conversation whose last rolling hash is the rolling hash of
an inner turn of another is a proper prefix of it, and an anti-join drops it. Of equal conversations the
one with the least conv_id stays. The rest is rendered.

Rolling hashes are made distinct (with partial aggregation) before the join, so a first turn that a third of all
conversations share is one row there. No two conversations are compared.

Defined cases: a null role is `unknown`, a null text is empty; a null turn stands first; rows without conv_id are
left out; rows of one conversation that are equal in turn, role and text count once, and turns that tie
are in order of role and text; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm import common

LANES = ("h0", "h1", "h2", "h3")


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, k, role, text, rolling hash) with k from 1."""
    own = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).filter("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    last = F.lag(F.struct("turn", "role", "text")).over(order)
    own = own.withColumn("again", F.coalesce(last.eqNullSafe(F.struct("turn", "role", "text")), F.lit(False))).filter("not again")
    own = own.withColumn("k", F.row_number().over(order).cast("long"))
    one, two = F.xxhash64("k", "role", "text"), F.xxhash64("text", "role", "k", F.lit(1))
    lanes = (one.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(one, 32), two.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(two, 32))
    return own.select("conv_id", "k", "role", "text", *[F.sum(x).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(h) for x, h in zip(lanes, LANES, strict=True)])


def render() -> F.Column:
    turns = F.transform(F.array_sort("turns"), lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n<|end|>\n")))
    return F.array_join(turns, "")


def collapse(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of the maximal conversations; n_copies counts equal ones."""
    turns = common.cut(_turns(conversations))
    last = turns.groupBy("conv_id").agg(F.max_by(F.struct("k", *LANES), "k").alias("e")).select("conv_id", "e.*")
    whole = common.cut(last.groupBy("k", *LANES).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies")))
    inner = turns.join(last.select(F.col("conv_id"), F.col("k").alias("n_turns")), "conv_id").filter("k < n_turns").select("k", *LANES).distinct()
    kept = whole.join(inner, ["k", *LANES], "left_anti").select("conv_id", F.col("k").alias("n_turns"), "n_copies")
    return turns.join(kept, "conv_id").groupBy("conv_id", "n_turns", "n_copies").agg(F.collect_list(F.struct("k", "role", "text")).alias("turns")).select("conv_id", "n_turns", "n_copies", render().alias("rendered"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(common.table(spark, sf_dir, "conversations"))


SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n_turns, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, turns FROM c GROUP BY n_turns, turns),
m AS (SELECT u.* FROM u WHERE NOT EXISTS (
  SELECT 1 FROM u v WHERE v.turns[1] = u.turns[1] AND v.n_turns > u.n_turns AND v.turns[1:u.n_turns] = u.turns))
SELECT conv_id, n_turns, n_copies,
  array_to_string(list_transform(turns, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || chr(10) || '<|end|>' || chr(10)), '') AS rendered
FROM m
"""

"""Repeated line runs by a suffix array over line ids; DataFrame functions only.

Lines become integer ids by sorting the distinct ones. Prefix doubling then ranks line suffixes by their
first 2, 4, ... lines: the rank of a place and that of the place half as many lines on, within the document,
are sorted as a pair and numbered (on the way to MIN_LINES, a step may be shorter). Places whose rank is unique can't
begin a longer repeat and leave the rounds; doubling ends when none is left.

Places of equal rank are an interval of the suffix array whose longest common prefix has that depth at least. Of each
interval the first place (by doc_id and line) stays. A later place looks at the deepest interval in which it isn't first:
its longest common prefix with that interval's first place comes from the ranks, from the deepest level down. A run
that goes on from the line before, with the same first copy, is part of that longer run; the others are the
maximal repeated runs. Those of MIN_LINES lines or more are deleted, and of shorter ones each later line that has
LONG_WORDS words by itself: a paragraph says enough alone, where a short line may stand in many texts by chance.

Line text leaves the scan as two 64-bit hashes (taken with different seeds); ids number the pairs, so two
different lines are taken as equal with a chance of 2**-128 a pair. Intervals are aggregated before
they are joined, and large ones are split by adaptive execution.

Defined cases: a null or empty text is one empty line; runs reach over the lines of one document alone; empty
lines count like others; rows that share a doc_id are one document with the least text; a null
doc_id is left out; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm import common

MIN_LINES = 2
LONG_WORDS = 50


def _numbered(rows: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """``rows`` that share their ``keys`` with another, with the keys' number in sorted order as ``rank``, and columns ``more``."""
    spark = rows.sparkSession
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    ordered = groups.repartitionByRange(common.partitions(spark), *keys).sortWithinPartitions(*keys)
    ranks = common.cut(ordered.select(*keys, F.monotonically_increasing_id().alias("rank")))
    return common.cut(rows.join(ranks, keys).select("doc_id", "line", "rank", *more))


def levels(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> list[tuple[int, DataFrame]]:
    """(depth, (doc_id, line, rank)) for growing depths: places whose next ``depth`` lines stand elsewhere too.

    No depth is more than twice the one before, ``min_lines`` is one of them, and beyond the last nothing repeats.
    The first level also says which lines are ``long``, that is of ``long_words`` words or more.
    """
    own = common.numbered_documents(docs)
    lines = own.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "value"))
    words = F.size(F.regexp_extract_all("value", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    # So many words have at least as many letters, and a space between each two.
    long = F.when(F.length("value") < 2 * long_words - 1, False).otherwise(words >= long_words)
    hashed = lines.select("doc_id", "line", F.xxhash64("value").alias("a"), F.xxhash64(F.lit(7), "value").alias("b"), long.alias("long"))
    depth, ranks = 1, _numbered(hashed, ["a", "b"], "long")
    found = [(depth, ranks)]
    while depth < min_lines or ranks.limit(1).count():
        step = min(depth, min_lines - depth) if depth < min_lines else depth
        after = ranks.select("doc_id", (F.col("line") - step).alias("line"), F.col("rank").alias("next"))
        ranks = _numbered(ranks.withColumnRenamed("rank", "own").join(after, ["doc_id", "line"]), ["own", "next"])
        depth += step
        found.append((depth, ranks))
    return found


def _later(ranks: DataFrame) -> DataFrame:
    """(doc_id, line, first): the places that aren't the first of their rank, and the place that is."""
    # Written out, so that the join is one of plain exchanges, whose large keys can be split.
    first = common.cut(ranks.groupBy("rank").agg(F.min(F.struct("doc_id", "line")).alias("first")))
    return ranks.join(first, "rank").filter(F.struct("doc_id", "line") != F.col("first")).select("doc_id", "line", "first")


def later_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, line, first_doc, first_line, n_lines): the maximal later copies of runs of ``min_lines`` lines or more."""
    return _runs(levels(docs, min_lines), min_lines)


def _runs(every: list[tuple[int, DataFrame]], min_lines: int) -> DataFrame:
    later = None
    for depth, ranks in every:
        if depth >= min_lines:
            own = _later(ranks).select("doc_id", "line", F.struct(F.lit(depth).alias("depth"), "first").alias("deep"))
            later = own if later is None else later.unionByName(own)
    later = later.groupBy("doc_id", "line").agg(F.max_by("deep", "deep.depth").alias("deep"))
    later = later.select("doc_id", "line", F.col("deep.first.doc_id").alias("first_doc"), F.col("deep.first.line").alias("first_line"), F.col("deep.depth").alias("n_lines"))
    before = F.lag(F.struct("line", "first_doc", "first_line")).over(Window.partitionBy("doc_id").orderBy("line"))
    goes_on = before == F.struct((F.col("line") - 1).alias("line"), "first_doc", (F.col("first_line") - 1).alias("first_line"))
    runs = common.cut(later.withColumn("goes_on", F.coalesce(goes_on, F.lit(False))).filter("not goes_on").drop("goes_on"))
    for depth, ranks in reversed(every):
        here = ranks.select("doc_id", F.col("line").alias("at"), F.col("rank").alias("here"))
        there = ranks.select(F.col("doc_id").alias("first_doc"), F.col("line").alias("first_at"), F.col("rank").alias("there"))
        runs = runs.withColumn("at", F.col("line") + F.col("n_lines")).withColumn("first_at", F.col("first_line") + F.col("n_lines"))
        runs = runs.join(here, ["doc_id", "at"], "left").join(there, ["first_doc", "first_at"], "left")
        # A deeper common prefix than the place's own interval has would be an interval of its own.
        longer = F.coalesce((F.col("here") == F.col("there")) & (F.col("n_lines") >= depth), F.lit(False))
        runs = common.cut(runs.select("doc_id", "line", "first_doc", "first_line", (F.col("n_lines") + F.when(longer, depth).otherwise(0)).alias("n_lines")))
    return runs


def later_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, line): the lines that later copies of repeated runs cover, and later copies of long lines."""
    every = levels(docs, min_lines, long_words)
    runs = _runs(every, min_lines)
    covered = runs.select("doc_id", F.explode(F.sequence(F.col("line"), F.col("line") + F.col("n_lines") - 1)).alias("line"))
    return covered.unionByName(_later(every[0][1].filter("long")).select("doc_id", "line")).distinct()


def drop_later_runs(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_runs, kept_text) for every document; a run is a stretch of removed lines."""
    by_line = Window.partitionBy("doc_id").orderBy("line")
    begins = F.when(F.col("line") == F.lag("line").over(by_line) + 1, 0).otherwise(1)
    gone = later_lines(docs, min_lines, long_words).withColumn("begins", begins)
    gone = gone.groupBy("doc_id").agg(F.array_sort(F.collect_list("line")).alias("gone"), F.sum("begins").alias("n_runs"))
    # The same join at every size, for what is gone grows with the documents.
    own = common.numbered_documents(docs).join(gone.hint("merge"), "doc_id", "left").withColumn("lines", F.split("text", "\n", -1))
    index = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(F.array_except(index, "gone"), lambda i: F.get("lines", i)), "\n")
    )
    return own.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_runs", F.lit(0)).cast("long").alias("n_runs"), kept.alias("kept_text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_later_runs(common.table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", "n_runs", common.sha256_text(F.col("kept_text")).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS value, unnest(range(len(lines))) AS line FROM d),
w AS (SELECT doc_id, line, value, lead(value) OVER (PARTITION BY doc_id ORDER BY line) AS next,
      lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS more FROM l),
f AS (SELECT doc_id, line, row_number() OVER (PARTITION BY value, next ORDER BY doc_id, line) AS turn FROM w WHERE more IS NOT NULL),
o AS (SELECT doc_id, line, row_number() OVER (PARTITION BY value ORDER BY doc_id, line) AS turn FROM l
      WHERE len(regexp_extract_all(value, '[^\x20\x09-\x0D]+')) >= 50),
g AS (SELECT doc_id, line + k AS line FROM f, (VALUES (0), (1)) AS v(k) WHERE turn > 1 UNION SELECT doc_id, line FROM o WHERE turn > 1),
r AS (SELECT doc_id, line, CASE WHEN line = lag(line) OVER (PARTITION BY doc_id ORDER BY line) + 1 THEN 0 ELSE 1 END AS begins FROM g),
s AS (SELECT doc_id, count(*) AS n_removed, sum(begins) AS n_runs FROM r GROUP BY doc_id),
k AS (SELECT l.doc_id, string_agg(l.value, chr(10) ORDER BY l.line) AS kept FROM l ANTI JOIN g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id)
SELECT d.doc_id, len(d.lines) AS n_lines, coalesce(s.n_removed, 0) AS n_removed, CAST(coalesce(s.n_runs, 0) AS BIGINT) AS n_runs, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""

"""Resampling towards a target distribution by hashed n-gram importance weights.

Runs of one to three words fall into buckets. A bucket's gain is the logarithm of its share in the target texts over
its share in the corpus, so an array of gains scores a document by one lookup a feature. Two passes read the text: the
first counts features by bucket (an array a task, summed by bucket), the second sums gains.

A draw adds Gumbel noise, taken from a hash of the doc_id, to the weight. The draw needs no sort of the corpus: rows are counted
by score, counts are summed from the highest score down, and the sum before a score is the rank offset of its rows.
The score at which the wanted number is reached is the cutoff; rows below it are never ranked, and the others are numbered by doc_id
within their score. The sums are made in up to ``BINS`` ranges of scores at once. Scores of different documents carry noise
of their own, so one score holds some 0.04 % of the rows of one weight at most, however often a text repeats.

CRC-32 of a run is made from those of its words, for appending bytes is linear in the code of what stands before.

Defined cases: a null or empty text has no features and weight 0; rows that share a doc_id are one document with the
least text; a null doc_id is left out; every row of the target counts, null texts hold nothing; other columns are ignored,
whatever their names; an empty table gives no rows, and an empty target is one without features.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm import common
from quillgraph.llm.kernels import LOWER, slices

BUCKETS = 10_000
MAX_WORDS = 3
MIN_WORDS = 20
#: Ranges of scores whose counts are summed at once.
BINS = 4096
#: Bytes that are appended by one lookup, and bytes of a word that are coded in step with other words.
STEP = 64

WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


# CRC-32 of many strings

@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code's byte table, and what n zero bytes make of each byte of a code: for n below STEP, and for powers of two."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, np.uint32(0xEDB88320) ^ (byte >> 1), byte >> 1)
    zero = lambda x: byte[x & 255] ^ (x >> 8)
    near = np.zeros((STEP, 4, 256), np.uint32)
    for k in range(4):
        near[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, STEP):
        near[n] = zero(near[n - 1])
    far = np.zeros((64, 4, 256), np.uint32)
    far[0] = near[1]
    for p in range(1, 64):
        far[p] = _apply(far[p - 1], far[p - 1])
    return byte, near, far


def _apply(table: np.ndarray, code: np.ndarray) -> np.ndarray:
    return table[0, code & 255] ^ table[1, (code >> 8) & 255] ^ table[2, (code >> 16) & 255] ^ table[3, code >> 24]


def appended(code: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What ``size`` bytes more make of the codes, before the code of those bytes is added."""
    _, near, far = _tables()
    low = size % STEP
    flat = near.reshape(-1)
    at = low * 1024
    out = flat[at + (code & 255)] ^ flat[at + 256 + ((code >> 8) & 255)] ^ flat[at + 512 + ((code >> 16) & 255)] ^ flat[at + 768 + (code >> 24)]
    power, more = STEP.bit_length() - 1, size // STEP
    while more.any():
        odd = np.flatnonzero(more & 1)
        out[odd] = _apply(far[power], out[odd])
        power, more = power + 1, more >> 1
    return out


def crc32s(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each data[start : start + size]; long strings one by one, all others a byte at a time together."""
    byte, _, _ = _tables()
    code = np.full(len(start), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] <= STEP]
    left, place = size[order], start[order]
    own = code[order]
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, "left"))  # those longer than k come first
        some = own[:n]
        own[:n] = byte[(some ^ data[place[:n] + k]) & 255] ^ (some >> 8)
    code[order] = own
    code ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > STEP):
        code[i] = zlib.crc32(data[start[i] : start[i] + size[i]])
    return code


# Features

class Features:
    """Buckets of all runs of one to three words of a slice of rows."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        data = LOWER[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at[:-1]] = True
        solid = WORD[data]
        start, last = solid.copy(), solid.copy()
        if len(data):
            start[1:] &= ~solid[:-1] | edge[1:-1]
            last[:-1] &= ~solid[1:] | edge[1:-1]
        start = np.flatnonzero(start)
        size = np.flatnonzero(last) + 1 - start
        self.word_at = np.searchsorted(start, at)
        code = crc32s(data, start, size)
        spaced = appended(np.full(len(start), zlib.crc32(b" "), np.uint32), size) ^ code
        self.buckets, self.ends = [], []
        for n in range(1, MAX_WORDS + 1):
            if n > 1:
                code = appended(code[:-1], size[n - 1 :] + 1) ^ spaced[n - 1 :] if len(code) > 1 else code[:0]
            self.buckets.append((code % BUCKETS).astype(np.int64))
            self.ends.append(np.maximum(self.word_at[1:] - (n - 1), self.word_at[:-1]))

    def words(self) -> np.ndarray:
        return np.diff(self.word_at)

    def runs(self) -> np.ndarray:
        return sum(e - self.word_at[:-1] for e in self.ends)

    def total(self, values: np.ndarray) -> np.ndarray:
        """The sum of ``values`` over the features of each row."""
        out = np.zeros(len(self.word_at) - 1, np.int64)
        for bucket, end in zip(self.buckets, self.ends, strict=True):
            upto = np.concatenate([[0], np.cumsum(values[bucket])])
            live = end > self.word_at[:-1]
            out[live] += upto[end[live]] - upto[self.word_at[:-1][live]]
        return out

    def count(self) -> np.ndarray:
        """How many features of all rows fall into each bucket."""
        out = np.zeros(BUCKETS + 1, np.int64)
        for bucket, end in zip(self.buckets, self.ends, strict=True):
            own = np.zeros(len(bucket) + 1, np.int64)  # a run that leaves its row doesn't count
            live = end > self.word_at[:-1]
            np.add.at(own, self.word_at[:-1][live], 1)
            np.add.at(own, end[live], -1)
            out += np.bincount(np.where(np.cumsum(own[:-1]) > 0, bucket, BUCKETS), minlength=BUCKETS + 1)
        return out[:BUCKETS]


def _count(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, data, at in slices(batch):
            total += Features(data, at).count()
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n) of the buckets that hold features."""
    return texts.select("text").mapInArrow(_count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each of the BUCKETS buckets."""
    counts = np.zeros((2, BUCKETS))
    for i, texts in enumerate((corpus, target)):
        for r in bucket_counts(texts).collect():  # BUCKETS rows at most
            counts[i, r["bucket"]] = r["n"]
    s, t = counts
    share = ((t + 1) * (s.sum() + BUCKETS)) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(share)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # BUCKETS integers

    def run(batches):
        for batch in batches:
            for rows, data, at in slices(batch):
                own = Features(data, at)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *map(pa.array, (own.words(), own.runs(), own.total(sent.value)))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


# The draw

def noise(seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(rows: DataFrame, wanted: int) -> DataFrame:
    """``rows`` (doc_id, score, eligible and others) with ``rank``: of the eligible ones, that of the ``wanted`` highest scores."""
    able = rows.filter("eligible")
    counts = common.cut(able.groupBy("score").agg(F.count(F.lit(1)).alias("n")))
    ends = counts.agg(F.min("score").alias("low"), F.max("score").alias("high")).first()
    unranked = F.lit(None).cast("long").alias("rank")
    if wanted <= 0 or ends["low"] is None:
        return rows.select("*", unranked)
    width = (ends["high"] - ends["low"]) // BINS + 1
    counts = counts.withColumn("bin", F.floor((F.lit(ends["high"]) - F.col("score")) / width).cast("long"))
    before, bins = 0, []
    for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").collect():  # BINS rows at most
        if before >= wanted:
            break
        bins.append((r["bin"], before))
        before += r["n"]
    known = counts.sparkSession.createDataFrame(bins, "bin bigint, before bigint")
    higher = Window.partitionBy("bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.join(F.broadcast(known), "bin").withColumn("offset", F.col("before") + F.coalesce(F.sum("n").over(higher), F.lit(0)))
    offsets = common.cut(offsets.filter(F.col("offset") < wanted).select("score", "offset"))
    cutoff = offsets.agg(F.min("score")).first()[0]
    turn = F.row_number().over(Window.partitionBy("score").orderBy("doc_id"))
    near = rows.filter(F.col("eligible") & (F.col("score") >= cutoff)).withColumn("turn", turn).join(offsets, "score")
    rank = F.col("offset") + F.col("turn")
    near = near.select(*rows.columns, F.when(rank <= wanted, rank).cast("long").alias("rank"))
    return near.unionByName(rows.filter(~F.col("eligible") | (F.col("score") < cutoff)).select("*", unranked))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = MIN_WORDS, seed: int = 42) -> DataFrame:
    """(doc_id, n_features, weight, score, rank); the documents with a rank are drawn."""
    own = common.numbered_documents(docs)
    scored = weights(own, gains(own, target)).withColumn("score", F.col("weight") + noise(seed)).withColumn("eligible", F.col("n_words") >= min_words)
    scored = common.cut(scored)
    total = scored.filter("eligible").count()
    return draw(scored, percent * total // 100).select("doc_id", "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))

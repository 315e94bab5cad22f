"""Mixing to target weights with soft domain membership.

1. Domains come from the labelled table: `toxic` (toxic 1), `low` (quality 0) and `clean`. A softmax regression on
   the presence of hashed words and word endings, fitted on a bounded sample of labelled rows (the SAMPLE first
   by a hash of doc_id), gives each document posteriors p over the domains. Features whose counts differ
   between domains by less than CHI_SQUARE are left out. (Naive Bayes, tried first, takes the words of a group of
   copies as so many independent signs: it called 38 % of clean documents toxic where this calls none so.)
2. A document of n words with rate r counts r * n * p_k words towards domain k. Rates r >= 0 are fitted
   by projected gradient descent on the squared differences between the domains' totals and their targets.
   Rates start at 1. The gradient for a document is n * (p . differences); it is scaled by 1 / n (so that the step
   doesn't depend on a document's length) and, for all at once, by the inverse of the matrix of sums of
   n * p_j * p_k over documents that can still move. So a step is r - p . L for a few numbers L, cut
   off at 0; the state after t steps is t vectors L, each iteration is one aggregation, and no rate is
   ever collected.
3. The targets are weights of the domains for a corpus in which `clean` keeps all the words it has. A
   document is taken floor(r) times, and once more if what is left over r exceeds a bound that its
   doc_id draws from (0, 1), evenly: the expected number of copies is the rate.

Defined cases: a null or empty text has no words, rate 1 and one copy; without labelled rows (or with one domain alone)
all posteriors are equal; a domain without any words can't be reached and is left out of the fit;
repeated rows are rows of their own with equal results; labels with nulls are passed over, and of several labels
of a document the least is taken; other columns pass through or are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm import common
from quillgraph.llm.kernels import LOWER, SLOT, Words, map_rows, mix as spread, prefix_hash, slices, substring

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.90, "low": 0.08, "toxic": 0.02}
SAMPLE = 6000
BITS = 18
LEAST_DOCUMENTS = 4
CHI_SQUARE = 25
PENALTY, RATE, ROUNDS = 1e-4, 0.05, 120
ENDING = 3
STEPS = 30
TOLERANCE = 1e-6


def _features(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The distinct features of each row: its words and the last ENDING bytes of each."""
    words = Words(data, at)
    endings = spread(substring(prefix_hash(LOWER[data]), np.maximum(words.start, words.end - ENDING), words.end) + SLOT[5])
    both = np.stack([words.hash, endings], 1) >> np.uint64(64 - BITS)
    return [np.unique(both[words.at[i] : words.at[i + 1]]).astype(np.int64) for i in range(len(at) - 1)]


def _presence(batches):
    for batch in batches:
        for part, data, at in slices(batch):
            found = [x.astype("<i4").tobytes() for x in _features(data, at)]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "domain": part.column(1), "features": pa.array(found, pa.binary())})


def _regression(rows: np.ndarray, columns: np.ndarray, domain: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of a softmax regression on 0/1 features, by Adam over the whole sample."""
    n, k = len(domain), len(DOMAINS)
    share = np.bincount(domain, minlength=k) / n
    bias, target = np.log(np.maximum(share, 1e-6)), np.eye(k)[domain]
    weights, one, two = np.zeros((width, k)), np.zeros((width, k)), np.zeros((width, k))
    for turn in range(1, ROUNDS + 1):
        logit = np.stack([np.bincount(rows, weights[columns, j], n) for j in range(k)], 1) + bias
        p = np.exp(logit - logit.max(1, keepdims=True))
        off = (p / p.sum(1, keepdims=True) - target) / n
        slope = np.stack([np.bincount(columns, off[rows, j], width) for j in range(k)], 1) + PENALTY * weights
        one, two = 0.9 * one + 0.1 * slope, 0.999 * two + 0.001 * slope * slope
        weights -= RATE * (one / (1 - 0.9**turn)) / (np.sqrt(two / (1 - 0.999**turn)) + 1e-8)
    bias[share == 0] = -1e9
    return weights, bias


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray | None:
    """Weights of each feature by domain, in a table whose last row is the intercepts; None without two domains."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 0)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain")).filter("doc_id is not null and domain is not null")
    known = known.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)  # so at most SAMPLE ids are broadcast
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text"))
    found = sorted(sample.mapInArrow(_presence, "doc_id bigint, domain int, features binary").collect(), key=lambda r: r["doc_id"])  # SAMPLE rows at most
    domains = np.array([r["domain"] for r in found], np.int64)
    if len(set(domains.tolist())) < 2:
        return None
    features = [np.frombuffer(r["features"], "<i4") for r in found]
    rows, columns = np.repeat(np.arange(len(features)), [len(x) for x in features]), np.concatenate(features)
    count = np.zeros((1 << BITS, len(DOMAINS)))
    np.add.at(count, (columns, domains[rows]), 1)
    expected = np.maximum(count.sum(1, keepdims=True) * np.bincount(domains, minlength=len(DOMAINS)) / len(domains), 1e-9)
    kept = np.flatnonzero((count.sum(1) >= LEAST_DOCUMENTS) & (((count - expected) ** 2 / expected).sum(1) >= CHI_SQUARE))
    place = np.full(1 << BITS, -1)
    place[kept] = np.arange(len(kept))
    use = place[columns] >= 0
    weights, bias = _regression(rows[use], place[columns[use]], domains, len(kept))
    table = np.zeros((1 << BITS, len(DOMAINS)), np.float32)
    table[kept] = weights
    return np.vstack([table, bias.astype(np.float32)])


def posteriors(docs: DataFrame, model: np.ndarray | None) -> DataFrame:
    """``docs`` with __words and the posterior of each domain; columns of these names that it has already are replaced."""
    docs = docs.drop("__words", *[f"__p_{d}" for d in DOMAINS], "__rate", "__copies")

    def work(part, data, at):
        words = Words(data, at)
        size = np.diff(words.at)
        logit = np.zeros((part.num_rows, len(DOMAINS)))
        if model is not None:
            logit += model[-1]
            for i, features in enumerate(_features(data, at)):
                logit[i] += model[features].sum(0)
        p = np.exp(logit - logit.max(1, keepdims=True)) if part.num_rows else logit
        p /= p.sum(1, keepdims=True)
        return [size, *(np.round(p[:, k], 9) for k in range(len(DOMAINS)))]

    return map_rows(docs, [("__words", T.LongType()), *((f"__p_{d}", T.DoubleType()) for d in DOMAINS)], work)


def _along(step: np.ndarray) -> Column:
    return sum((F.col(f"__p_{d}") * F.lit(float(x)) for d, x in zip(DOMAINS, step, strict=True)), F.lit(0.0))


def _rate(steps: list[np.ndarray]) -> Column:
    rate = F.lit(1.0)
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate - _along(step))
    return rate


def fit_rates(found: DataFrame, targets: dict[str, float] | None = None) -> tuple[list[np.ndarray], float, dict]:
    """The steps of the descent, the unit of words, and what came out: totals before, after, and targets.

    ``found`` is read once for each step, so it should be written out.
    """
    share = np.array([(targets or TARGETS)[d] for d in DOMAINS])
    small = found
    first = small.agg(F.avg("__words").alias("m"), *[F.sum(F.col("__words") * F.col(f"__p_{d}")).alias(d) for d in DOMAINS]).first()
    scale = float(first["m"] or 0) or 1.0
    before = np.array([float(first[d] or 0) for d in DOMAINS]) / scale
    if before[0] <= 0 or share[0] <= 0:
        return [], scale, {"before": before * scale, "after": before * scale, "targets": before * scale}
    want = np.where(before > 1e-9, before[0] * share / share[0], 0)
    steps: list[np.ndarray] = []
    size = F.col("__words") / F.lit(scale)
    k = len(DOMAINS)
    while True:
        rated = small.withColumn("r", _rate(steps))
        move = F.when(F.col("r") > 0, size).otherwise(0.0)
        sums = rated.agg(
            *[F.sum(F.col("r") * size * F.col(f"__p_{d}")).alias(f"t{i}") for i, d in enumerate(DOMAINS)],
            *[F.sum(move * F.col(f"__p_{DOMAINS[i]}") * F.col(f"__p_{DOMAINS[j]}")).alias(f"g{i}{j}") for i in range(k) for j in range(i, k)],
        ).first()
        now = np.array([sums[f"t{i}"] for i in range(k)])
        off = now - want
        if len(steps) >= STEPS or np.abs(off).max() <= TOLERANCE * max(1.0, want.max()):
            return steps, scale, {"before": before * scale, "after": now * scale, "targets": want * scale}
        gram = np.array([[sums[f"g{min(i, j)}{max(i, j)}"] for j in range(k)] for i in range(k)])
        steps.append(np.round(np.linalg.lstsq(gram + np.eye(k) * 1e-9 * max(1e-9, np.trace(gram)), off, rcond=None)[0], 12))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with __words, the posteriors, __rate and __copies; texts are looked at twice, for they aren't written out."""
    found = posteriors(docs, fit(docs, labels))
    steps, _, _ = fit_rates(common.cut(found.select("__words", *[f"__p_{d}" for d in DOMAINS])), targets)
    return rated(found, steps)


def rated(found: DataFrame, steps: list[np.ndarray]) -> DataFrame:
    left = F.col("__rate") - F.floor("__rate")
    bound = (F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("mix")), F.lit(1_000_000)) + 0.5) / 1_000_000.0
    with_rate = found.withColumn("__rate", F.round(F.when(F.col("__words") == 0, F.lit(1.0)).otherwise(_rate(steps)), 6))
    return with_rate.withColumn("__copies", (F.floor("__rate") + F.when(left > bound, 1).otherwise(0)).cast("long"))


def take(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes at least once, with all their columns.

    A row is kept once here: whoever samples from the result repeats it by the rate.
    """
    own = ("doc_id", "text")
    return common.restored(mix(common.sheltered(docs, *own), labels).filter("__copies > 0"), docs, *own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = common.cut(posteriors(docs, fit(docs, common.table(spark, sf_dir, "labels"))).drop("text"))
    return rated(found, fit_rates(found)[0]).select("doc_id", F.col("__words").alias("n_words"), *[F.col(f"__p_{d}").alias(f"p_{d}") for d in DOMAINS], F.col("__rate").alias("rate"), F.col("__copies").alias("copies"))

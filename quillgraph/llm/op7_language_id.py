"""Language identification by nearest centroid.

A text is the vector of its hashed byte 3-grams (lower case, other ASCII than letters folded to a space),
weighted log(1 + count) * idf and scaled to length one. Each language has up to CLUSTERS centroids from
spherical k-means over a bounded sample of labelled rows. A cluster of less than LEAST_ROWS rows is dissolved: they
join the nearest of the others. The language of the centroid with the largest cosine is predicted, and the
cosine is the score. A text farther from its centroid than SLACK times the language's limit is rejected: the
distance of the farthest sample text of those that were in a large enough cluster at first.

Sample: of the rows with a language and a text whose crc32(doc_id as text) mod 5 is not 0, the
SAMPLE_PER_LANGUAGE first by a hash of doc_id for each language. The idf is that of the sample.

Defined cases: a null text or one without a letter is `und` with score 0 and rejected, as is every text if there
is nothing to learn from; rows are independent, so repeated rows get equal results; a null doc_id is not
held out and never learned from; other columns pass through or are ignored, and columns that have the names of
the result's are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm import common
from quillgraph.llm.kernels import map_rows, slices

BITS = 13
SAMPLE_PER_LANGUAGE = 600
CLUSTERS = 3
#: Rows of a sample that a cluster needs; a language with fewer is one cluster.
LEAST_ROWS = 10
#: Distances nearer than this are equal: the stored centroids are single floats.
ROUNDING = 1e-5
SLACK = 1.05
UNKNOWN = "und"
_CHUNK = 256
#: Rows whose temporary arrays are held at once.
_BLOCK = 32
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32
_LETTER = re.compile(r"[^\W\d_]")


def _counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Feature counts of each row; callers bound the number of rows."""
    out = np.zeros((len(at) - 1, 1 << BITS), np.float32)
    folded = _FOLD[data]
    if len(folded) >= 3:
        grams = (folded[:-2] << np.uint32(16)) | (folded[1:-1] << np.uint32(8)) | folded[2:]
        grams = (grams * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        for i in range(len(at) - 1):
            own = grams[at[i] : max(at[i], at[i + 1] - 2)]
            out[i] = np.bincount(own, minlength=1 << BITS)
    return out


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The only large array made is the result: workers keep what the stages before have left in them."""
    x = np.log1p(counts, dtype=np.float64)
    x *= idf
    for lo in range(0, len(x), _BLOCK):
        some = x[lo : lo + _BLOCK]
        some /= np.maximum(np.sqrt((some * some).sum(1, keepdims=True)), 1e-12)
    return x


def _sample_counts(table: pa.Table) -> Iterator[np.ndarray]:
    """Counts of the sample in order of doc_id, ``_BLOCK`` rows at most at a time."""
    table = table.sort_by("doc_id").combine_chunks()
    for b in table.to_batches():
        for _, data, at in slices(b):
            for lo in range(0, len(at) - 1, _BLOCK):
                own = at[lo : lo + _BLOCK + 1]
                yield _counts(data[own[0] : own[-1]], own - own[0])


def _document_counts(table: pa.Table) -> pa.Table:
    df = np.zeros(1 << BITS, np.int64)
    for counts in _sample_counts(table):
        df += (counts > 0).sum(0)
    return pa.table({"n": pa.array([table.num_rows], pa.int64()), "df": pa.array([df.astype(np.float32).tobytes()], pa.binary())})


def _sum(x: np.ndarray, which: np.ndarray) -> np.ndarray:
    """``x[which].sum(0)`` without the copy of the rows."""
    out = np.zeros(x.shape[1])
    for i in np.flatnonzero(which):
        out += x[i]
    return out


def _spherical(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroids after rounds of k-means from ``centre``, and the one of each row."""
    for _ in range(12):
        own = (x @ centre.T).argmax(1)
        centre = np.stack([_sum(x, own == k) if (own == k).any() else centre[k] for k in range(len(centre))])
        centre /= np.maximum(np.sqrt((centre * centre).sum(1, keepdims=True)), 1e-12)
    return centre, (x @ centre.T).argmax(1)


def _centroids(idf: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        x, lo = np.empty((table.num_rows, 1 << BITS)), 0
        for counts in _sample_counts(table):
            x[lo : lo + len(counts)] = _vectors(counts, idf)
            lo += len(counts)
        # Seeds at even ranks of similarity to the mean, for the farthest texts are outliers.
        order = np.argsort(x @ x.mean(0), kind="stable")
        n = max(1, min(CLUSTERS, len(x) // LEAST_ROWS))
        centre = x[order[(2 * np.arange(n) + 1) * len(x) // (2 * n)]]
        centre, own = _spherical(x, centre)
        size = np.bincount(own, minlength=len(centre))
        enough = size >= min(LEAST_ROWS, size.max())
        usual = enough[own]
        if not enough.all():
            centre, own = _spherical(x, centre[enough])
        far = float(1 - (x @ centre.T).max(1)[usual].min())
        lang = table.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([lang] * len(centre)), "centre": pa.array([c.astype(np.float32).tobytes() for c in centre], pa.binary()), "far": pa.array([far] * len(centre), pa.float64())})

    return run


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """(idf, language of each centroid, centroids, largest distance of each)."""
    usable = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    chosen = common.first_by_hash(usable.select("doc_id", "lang").distinct(), "lang", "doc_id", SAMPLE_PER_LANGUAGE)
    # At most SAMPLE_PER_LANGUAGE ids for each language.
    sample = usable.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    sample = common.cut(sample)
    counts = sample.groupBy("lang").applyInArrow(_document_counts, "n bigint, df binary").collect()  # a row for each language
    if not counts:
        return np.zeros(1 << BITS, np.float32), [], np.zeros((0, 1 << BITS), np.float32), np.zeros(0)
    n, df = sum(r["n"] for r in counts), sum(np.frombuffer(r["df"], np.float32) for r in counts)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32)
    rows = sorted(sample.groupBy("lang").applyInArrow(_centroids(idf), "lang string, centre binary, far double").collect(), key=lambda r: (r["lang"], r["centre"]))
    return idf, [r["lang"] for r in rows], np.stack([np.frombuffer(r["centre"], np.float32) for r in rows]), np.array([r["far"] for r in rows])


def annotate(docs: DataFrame, model=None, names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` with the predicted language, the score and whether the distance rejects it.

    Columns of these names that ``docs`` has already are replaced.
    """
    idf, langs, centres, far = model or fit(docs)
    centres = centres.astype(np.float64)
    docs = docs.drop(*names)

    def work(part, data, at):
        texts = part.column(part.schema.get_field_index("text")).to_pylist()
        pred, score, rejected = [], [], []
        for lo in range(0, len(texts), _CHUNK):
            hi = min(len(texts), lo + _CHUNK)
            near = _vectors(_counts(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]), idf) @ centres.T if langs else None
            for i in range(lo, hi):
                if not langs or not texts[i] or not _LETTER.search(texts[i]):
                    k, s = None, 0.0
                else:
                    k = int(near[i - lo].argmax())
                    s = float(min(1.0, max(0.0, near[i - lo, k])))
                pred.append(UNKNOWN if k is None else langs[k])
                score.append(s)
                rejected.append(k is None or 1 - s > SLACK * far[k] + ROUNDING)
        return pred, score, rejected

    return map_rows(docs, list(zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)), work)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    own = ("doc_id", "lang", "text")
    found = annotate(common.sheltered(docs, *own), model=fit(docs))
    return common.restored(found.filter("not rejected"), docs, *own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs)
    return annotate(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")

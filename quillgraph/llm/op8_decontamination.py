"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Two passes over the texts, one block of benchmark items at a time (of some BLOCK_ITEMS and BLOCK_BYTES, so what is
broadcast has a bound, but for a single item that is longer):
1. the document frequency, over all documents, of every SEED_WORDS-gram of the items;
2. seeds are each item's rarest grams among those that occur (RARE_SHARE of them, and all ties with the last), so
   an item whose every gram is frequent, being leaked often, keeps its seeds. Places of a document with
   SEEDS seeds of one item, or as many as the item has, are aligned with the item, word by word. Where these
   don't reach THRESHOLD, all grams that the document shares with the item are its seeds: copies may keep
   frequent grams alone. A place that holds too few of the item's words to reach THRESHOLD isn't aligned.

The score of an alignment is MATCH for equal words (A-Z lower-cased), MISMATCH for replaced, GAP for
inserted or lost ones, as a share of the item's own score, so 1 is a whole copy; a document with a score
of THRESHOLD or more for any item is contaminated.

Defined cases: null or empty texts have no words and are clean; items under SEED_WORDS words say little about
the texts around them, so only a document that is such an item, word for word, holds it; items without id, text or
words are passed over; repeated items count once for each
row's id; rows of documents are independent; other columns pass through or are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm import common
from quillgraph.llm.kernels import Words, map_rows, slices

SEED_WORDS = 3
RARE_SHARE = 0.5
SEEDS = 2
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 8 << 20


class Index:
    """The items of one block: their words' hashes, and which item and place each gram has."""

    def __init__(self, items: list[tuple[int, str]]):
        raw = [t.encode() for _, t in items]
        at = np.cumsum([0, *map(len, raw)]).astype(np.int64)
        words = Words(np.frombuffer(b"".join(raw), np.uint8), at)
        grams, gram_at = words.grams(SEED_WORDS)
        self.ids = [i for i, _ in items]
        self.words = [words.hash[words.at[k] : words.at[k + 1]] for k in range(len(items))]
        #: Items without a gram, by their words.
        self.short: dict[bytes, list[int]] = {}
        for k, own in enumerate(self.words):
            if 0 < len(own) < SEED_WORDS:
                self.short.setdefault(own.tobytes(), []).append(k)
        self.grams = np.unique(grams)
        self.code = np.searchsorted(self.grams, grams)
        self.item = np.repeat(np.arange(len(items)), np.diff(gram_at))
        self.place = np.arange(len(grams)) - np.repeat(gram_at[:-1], np.diff(gram_at))

    def keep_rare(self, df: np.ndarray) -> None:
        """Keep the grams that occur in documents, and mark the rarest of each item as seeds."""
        own = df[self.code]
        keep = own > 0
        here = np.flatnonzero(keep)
        here = here[np.lexsort((own[here], self.item[here]))]
        items, first, count = np.unique(self.item[here], return_index=True, return_counts=True)
        last = np.zeros(len(self.ids), np.int64)
        last[items] = own[here][first + np.maximum(np.minimum(count, 6), np.ceil(count * RARE_SHARE).astype(np.int64)) - 1]
        rare = keep & (own <= last[self.item])
        order = np.flatnonzero(keep)[np.argsort(self.code[keep], kind="stable")]
        self.code, self.item, self.place, self.rare = self.code[order], self.item[order], self.place[order], rare[order]
        self.first = np.searchsorted(self.code, np.arange(len(self.grams) + 1))
        self.needed = np.minimum(SEEDS, np.bincount(self.item, minlength=len(self.ids)))

    def lookup(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where grams of a text are among the items' grams, and which."""
        if not len(self.grams) or not len(grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        found = np.flatnonzero(self.grams[code] == grams)
        return found, code[found]


def smith_waterman(item: np.ndarray, text: np.ndarray) -> int:
    """The best local alignment's score; a row at a time."""
    step = -GAP * np.arange(len(text) + 1)
    row, best = np.zeros(len(text) + 1, np.int64), 0
    for word in item:
        new = np.zeros(len(text) + 1, np.int64)
        new[1:] = np.maximum(np.maximum(row[:-1] + np.where(text == word, MATCH, MISMATCH), row[1:] + GAP), 0)
        row = np.maximum.accumulate(new + step) - step
        best = max(best, int(row.max()))
    return best


def _df(index: Index):
    def run(batches):
        count = np.zeros(len(index.grams), np.int64)
        for batch in batches:
            for _, data, at in slices(batch):
                grams, gram_at = Words(data, at).grams(SEED_WORDS)
                found, code = index.lookup(grams)
                doc = np.searchsorted(gram_at, found, "right")
                seen = np.unique(doc * max(1, len(index.grams)) + code)
                count += np.bincount(seen % max(1, len(index.grams)), minlength=len(index.grams))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"code": some, "n": count[some]}, schema=pa.schema([("code", pa.int64()), ("n", pa.int64())]))

    return run


def _best(index: Index, k: int, begin: np.ndarray, own: np.ndarray) -> float:
    """The best share of item ``k`` near where seeds say that it begins."""
    best, size = 0.0, len(index.words[k])
    begin, count = np.unique(begin, return_counts=True)
    cuts = np.flatnonzero(np.diff(begin) > 2 * size) + 1
    for run, n in zip(np.split(begin, cuts), np.split(count, cuts), strict=True):
        if n.sum() < index.needed[k]:
            continue
        window = own[max(0, run[0] - size // 2) : run[-1] + size + size // 2]
        if np.isin(index.words[k], window).sum() >= THRESHOLD * size:
            best = max(best, smith_waterman(index.words[k], window) / (MATCH * size))
    return best


def _hits(index: Index, words: Words, grams, gram_at, row: int) -> list[tuple[int, float]]:
    """(item, score) of the row's alignments, or of the short items that the row is."""
    if words.at[row + 1] - words.at[row] < SEED_WORDS:
        return [(k, 1.0) for k in index.short.get(words.hash[words.at[row] : words.at[row + 1]].tobytes(), ())]
    found, code = index.lookup(grams[gram_at[row] : gram_at[row + 1]])
    if not len(found):
        return []
    n = index.first[code + 1] - index.first[code]
    entry = np.arange(n.sum()) + np.repeat(index.first[code] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    order = np.argsort(index.item[entry], kind="stable")
    entry, at = entry[order], np.repeat(found, n)[order]
    items, edges = np.unique(index.item[entry], return_index=True)
    edges = np.append(edges, len(entry))
    own = words.hash[words.at[row] : words.at[row + 1]]
    out: dict[int, float] = {}
    for i in np.flatnonzero(np.diff(edges) >= index.needed[items]):
        k, here = items[i], entry[edges[i] : edges[i + 1]]
        begin, rare = at[edges[i] : edges[i + 1]] - index.place[here], index.rare[here]
        best = _best(index, k, begin[rare], own)
        if best < THRESHOLD and not rare.all():
            best = _best(index, k, begin, own)
        if best >= THRESHOLD:
            out[k] = best
    return list(out.items())


def _search(docs: DataFrame, index: Index, names: list[str]) -> DataFrame:
    def work(part, data, at):
        words = Words(data, at)
        grams, gram_at = words.grams(SEED_WORDS)
        count, best, score = [], [], []
        for row in range(len(at) - 1):
            hits = sorted((-s, index.ids[k]) for k, s in _hits(index, words, grams, gram_at, row))
            count.append(len(hits))
            best.append(hits[0][1] if hits else None)
            score.append(round(-hits[0][0], 6) if hits else 0.0)
        return count, best, score

    return map_rows(docs, list(zip(names, (T.LongType(), T.LongType(), T.DoubleType()), strict=True)), work)


def annotate(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with __n_items, __best_item and __best_score of the alignments that reach THRESHOLD.

    Columns of these names that ``docs`` has already are replaced.
    """
    docs = docs.drop("__n_items", "__best_item", "__best_score")
    whole, docs = docs, common.sheltered(docs, "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(size["n"] // block_items, (size["bytes"] or 0) // block_bytes) + 1
    texts = docs.select("text")
    out = docs
    for k in range(blocks):
        own = [(r["item_id"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()]
        index = Index(own)
        counted = texts.mapInArrow(_df(index), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()  # a row for each gram of the block
        df = np.zeros(len(index.grams), np.int64)
        for r in counted:
            df[r["code"]] = r["n"]
        index.keep_rare(df)
        out = _search(out, index, [f"__n_{k}", f"__item_{k}", f"__score_{k}"])
    best = F.array_max(F.array(*[F.struct(F.col(f"__score_{k}").alias("score"), (-F.col(f"__item_{k}")).alias("item")) for k in range(blocks)]))
    return out.select(
        *[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in whole.columns],
        sum((F.col(f"__n_{k}") for k in range(1, blocks)), F.col("__n_0")).alias("__n_items"),
        (-best["item"]).alias("__best_item"),
        best["score"].alias("__best_score"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    found = annotate(common.sheltered(docs, "text"), benchmark)
    return common.restored(found.filter("__n_items = 0"), docs, "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annotate(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.col("__n_items") > 0).alias("contaminated"), F.col("__n_items").alias("n_items"), F.col("__best_item").alias("best_item"), F.col("__best_score").alias("best_score"))

"""Removal of bytes covered by a 400-byte string that starts twice, by prefix-free parsing.

Parsing. A rolling hash runs over the bytes; its least value within a stretch of WINDOW positions is a
trigger. Every LENGTH-byte string then holds a first and a last trigger that depend on its own
bytes alone, so equal strings parse alike: head, phrases from first to last trigger, tail. Neighbouring
strings mostly have the same two triggers; such a run of starts is a *piece*. A text has about one
piece for each 30 bytes, and only pieces leave the tasks, as two hashes: that of the phrases
(the core) and that of the piece's whole extent.

Order. Pieces are dealt to buckets by core, so all suffixes that begin with the same phrases are ordered
together, which is as deep as the LENGTH bytes reach. Where an extent occurs twice, every string
of the piece does (the inner part of any repeat, and all of an exact copy). Where a core occurs
with different extents (the ends of repeats), each string of those pieces is hashed and
counted in turn. Where a core occurs once, no string of the piece can repeat.

Documents are dealt into batches of bounded bytes by a hash of doc_id. A batch asks about each distinct piece
once and gets the answers in the order asked, so a passage that a third of the corpus holds is one
entry for each batch in its bucket.

Only classes of equal order matter for the result, so the order within buckets is that of hashes and not
of bytes. They have 62 bits in two random bases: two different strings of n bytes are taken as equal with a chance of
(n / 2**31) ** 2 at most.

Defined cases: null or empty texts and those under 400 bytes have nothing removed unless they are long
enough; rows that share a doc_id are one document with the least text; a null doc_id is left out; other
columns are ignored; cuts may fall within a UTF-8 character, for strings are bytes here.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import common
from quillgraph.llm.kernels import SLOT, mix, prefix_hash, rolling, slices, substring

LENGTH = 400
GRAM = 24
WINDOW = 128
BATCH_BYTES = 12 << 20
#: Pieces, or strings, that a bucket holds on average.
BUCKET_ENTRIES = 2_000_000
_PLACE = np.uint64((1 << 31) - 1)


def _least(keys: np.ndarray) -> np.ndarray:
    step = 1
    while step < WINDOW:
        keys = np.minimum(keys[:-step], keys[step:])
        step *= 2
    return keys


def _hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(substring(prefix, start, end) + (end - start).astype(np.uint64) * SLOT[3])


class Part:
    """The pieces of one slice: first and last start of each, core and extent."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, at: np.ndarray):
        self.ids, self.data, self.at = ids, data, at
        self.prefix = prefix_hash(data)
        self.first = self.last = np.zeros(0, np.int64)
        self.core = self.extent = np.zeros(0, np.uint64)
        starts = len(data) - LENGTH + 1
        if starts <= 0:
            return
        place = np.arange(len(data) - GRAM + 1, dtype=np.int64)
        rolled = (rolling(data, GRAM) >> np.uint64(31)) << np.uint64(31)
        left = (_least(rolled | place.astype(np.uint64)) & _PLACE).astype(np.int64)[:starts]
        right = (_PLACE - (_least(rolled | (_PLACE - place.astype(np.uint64))) & _PLACE)).astype(np.int64)
        right = right[LENGTH - GRAM - WINDOW + 1 :][:starts]
        end = np.repeat(at[1:], np.diff(at))[:starts]
        whole = np.arange(starts) + LENGTH <= end
        new = whole.copy()
        new[1:] &= ~whole[:-1] | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        over = whole.copy()
        over[:-1] &= ~whole[1:] | new[1:]
        self.first, self.last = np.flatnonzero(new), np.flatnonzero(over)
        self.core = _hash(self.prefix, left[self.first], right[self.first] + GRAM)
        self.extent = _hash(self.prefix, self.first, self.last + LENGTH)


class Batch:
    """All pieces of a batch, and the distinct ones in a fixed order."""

    def __init__(self, table: pa.Table, buckets: int):
        table = table.sort_by("doc_id").combine_chunks()
        self.parts = [Part(b.column("doc_id").to_numpy(), data, at) for rows in table.to_batches() for b, data, at in slices(rows)]
        core = np.concatenate([p.core for p in self.parts]) if self.parts else np.zeros(0, np.uint64)
        extent = np.concatenate([p.extent for p in self.parts]) if self.parts else np.zeros(0, np.uint64)
        self.starts = np.cumsum([0, *(len(p.core) for p in self.parts)])
        order = np.lexsort((extent, core, core % np.uint64(buckets)))
        new = np.ones(len(order), bool)
        new[1:] = (core[order][1:] != core[order][:-1]) | (extent[order][1:] != extent[order][:-1])
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        #: One piece for each distinct one, by bucket, core and extent.
        self.one = order[new]
        self.core, self.extent = core[self.one], extent[self.one]
        self.often = np.bincount(self.which, minlength=len(self.one)) > 1

    def strings(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, part and start of each string of the distinct pieces with a code of 2 or more."""
        hashes, parts, places = [], [], []
        asked = np.sort(self.one[codes >= 2])
        for k, p in enumerate(self.parts):
            own = asked[(asked >= self.starts[k]) & (asked < self.starts[k + 1])] - self.starts[k]
            n = p.last[own] - p.first[own] + 1
            place = np.arange(n.sum()) + np.repeat(p.first[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(own) else np.zeros(0, np.int64)
            hashes.append(_hash(p.prefix, place, place + LENGTH))
            parts.append(np.full(len(place), k))
            places.append(place)
        cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        return cat(hashes, np.uint64), cat(parts, np.int64), cat(places, np.int64)


def _rows(batch: int, bucket: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """A row for each bucket; ``bucket`` is ascending."""
    some, first = np.unique(bucket, return_index=True)
    runs = list(zip(first.tolist(), np.append(first[1:], len(bucket)).tolist()))  # none of nothing
    return pa.table(
        {"batch": pa.array([batch] * len(some), pa.int64()), "bucket": pa.array(some.astype(np.int32))}
        | {k: pa.array([v[i:j].tobytes() for i, j in runs], pa.binary()) for k, v in columns.items()}
    )


def _ask(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        own = Batch(table, buckets)
        return _rows(table.column("batch")[0].as_py(), (own.core % np.uint64(buckets)).astype(np.int64), core=own.core, extent=own.extent, often=own.often)

    return run


def _read(table: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    raw = table.column(name).to_pylist()
    return np.frombuffer(b"".join(raw), kind), np.cumsum([0, *(len(x) // np.dtype(kind).itemsize for x in raw)])


def _answers(table: pa.Table, codes: np.ndarray, at: np.ndarray, kind: int) -> pa.Table:
    return pa.table(
        {
            "batch": table.column("batch"),
            "bucket": table.column("bucket"),
            "kind": pa.array([kind] * table.num_rows, pa.int32()),
            "codes": pa.array([codes[at[i] : at[i + 1]].tobytes() for i in range(table.num_rows)], pa.binary()),
        }
    )


def _judge_pieces(table: pa.Table) -> pa.Table:
    """0: can't repeat; 1: all repeat; 2: all repeat, and stands for its extent; 3: to be looked into."""
    table = table.sort_by("batch")
    core, at = _read(table, "core", np.uint64)
    extent, _ = _read(table, "extent", np.uint64)
    often, _ = _read(table, "often", bool)
    order = np.lexsort((extent, core))
    c, e = core[order], extent[order]
    new_c, new_e = np.ones(len(c), bool), np.ones(len(c), bool)
    new_c[1:] = c[1:] != c[:-1]
    new_e[1:] = new_c[1:] | (e[1:] != e[:-1])
    group_c, group_e = np.cumsum(new_c) - 1, np.cumsum(new_e) - 1
    repeated = (np.bincount(group_e) + np.bincount(group_e, often[order]) > 1)[group_e] if len(c) else np.zeros(0, bool)
    several = (np.bincount(group_c, new_e) > 1)[group_c] if len(c) else np.zeros(0, bool)
    codes = np.empty(len(c), np.uint8)
    codes[order] = np.where(repeated, np.where(several & new_e, 2, 1), np.where(several, 3, 0))
    return _answers(table, codes, at, 0)


def _ask_strings(buckets: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        own = Batch(docs, buckets)
        hashes, _, _ = own.strings(_told(told, 0))
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return _rows(docs.column("batch")[0].as_py() if docs.num_rows else -1, bucket[order], string=hashes[order])

    return run


def _judge_strings(table: pa.Table) -> pa.Table:
    string, at = _read(table.sort_by("batch"), "string", np.uint64)
    _, where, count = np.unique(string, return_inverse=True, return_counts=True)
    return _answers(table.sort_by("batch"), (count[where] > 1).astype(np.uint8), at, 1)


def _told(answers: pa.Table, kind: int) -> np.ndarray:
    own = answers.filter(pa.compute.equal(answers.column("kind"), kind)).sort_by("bucket")
    return np.frombuffer(b"".join(own.column("codes").to_pylist()), np.uint8)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _remove(buckets: int, with_kept: bool):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        own = Batch(docs, buckets)
        codes = _told(told, 0)
        hashes, part, place = own.strings(codes)
        order = np.argsort((hashes % np.uint64(buckets)).astype(np.int64), kind="stable")
        repeats = np.zeros(len(hashes), bool)
        repeats[order] = _told(told, 1) > 0
        sure = (codes[own.which] == 1) | (codes[own.which] == 2) if len(own.which) else np.zeros(0, bool)
        out: dict[str, list] = {k: [] for k in _RESULT.names}
        for k, p in enumerate(own.parts):
            here = sure[own.starts[k] : own.starts[k + 1]]
            singles = place[(part == k) & repeats]
            change = np.zeros(len(p.data) + 1, np.int32)
            np.add.at(change, p.first[here], 1)
            np.add.at(change, p.last[here] + LENGTH, -1)
            np.add.at(change, singles, 1)
            np.add.at(change, singles + LENGTH, -1)
            gone = np.cumsum(change[:-1]) > 0
            for i, doc in enumerate(p.ids):
                mine = gone[p.at[i] : p.at[i + 1]]
                kept = p.data[p.at[i] : p.at[i + 1]][~mine].tobytes()
                out["doc_id"].append(int(doc))
                out["n_bytes"].append(len(mine))
                out["n_removed"].append(int(mine.sum()))
                out["n_spans"].append(int((mine[1:] & ~mine[:-1]).sum() + mine[0]) if len(mine) else 0)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept if with_kept else None)
        return pa.Table.from_pydict(out, schema=_RESULT)

    return run


def remove_repeats(docs: DataFrame, with_kept: bool = True, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) for every document."""
    spark = docs.sparkSession
    own = common.numbered_documents(docs)
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(common.partitions(spark), total // batch_bytes + 1)
    buckets = max(common.partitions(spark), total // 32 // BUCKET_ENTRIES + 1)
    own = own.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)))
    answer = "batch bigint, bucket int, kind int, codes binary"
    asked = own.groupBy("batch").applyInArrow(_ask(buckets), "batch bigint, bucket int, core binary, extent binary, often binary")
    pieces = common.cut(asked.groupBy("bucket").applyInArrow(_judge_pieces, answer))
    by_batch = own.groupBy("batch")
    strings = by_batch.cogroup(pieces.groupBy("batch")).applyInArrow(_ask_strings(buckets), "batch bigint, bucket int, string binary")
    answered = common.cut(strings.groupBy("bucket").applyInArrow(_judge_strings, answer))
    told = pieces.unionByName(answered)
    return by_batch.cogroup(told.groupBy("batch")).applyInArrow(_remove(buckets, with_kept), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(common.table(spark, sf_dir, "documents"), with_kept=False).drop("kept")
    return found.withColumn("has_repeats", F.col("n_removed") > 0)

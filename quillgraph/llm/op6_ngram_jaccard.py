"""Similarity join on 5-word shingles: prefix filtering with the rarest shingles first.

1. Each document's shingle hashes go to the bucket of their hash as packed arrays; a bucket counts
   in how many documents each occurs and sends on those that occur in several, packed by the
   documents' home. A shingle that occurs once can't link anything, and it stands first in the rare-first
   order, so the number of them gives the positions of all others.
2. Documents with equal sets are one class; its least doc_id stands for it.
3. A class lists the repeated shingles within its prefix (n - ceil(0.8 n) + 1 of them). Classes that
   share one are candidates if the length and positional filters let them pass. The suffix filter
   (a histogram over hash ranges bounds the overlap) comes before the exact count.
4. Candidates are first tried against the head of each shingle's list and the entry before, then against
   neighbours in shuffled orders; what is still in different components is tried last, all pairs of a list that pass
   the filters. No pair is verified twice. So a large group of near copies costs about one verification for
   each member, not for each pair, and no link that matters for a component is lost.
5. Where links are asked for, the pairs of each component are counted: one by one in components of up to SMALL classes,
   else as products of 0/1 matrices over two blocks of classes at a time, which gives all
   overlaps of the blocks without a row for any pair.

A list longer than LIST entries is split by a hash of doc_id for its windows, and one longer than SMALL into
pairs of blocks for the last step, so that no list or component is one task.

Hashes have 64 bits for whole sets and for counting, and at least 40 plus those of the bucket in the
join, so that a false common shingle within a pair has a chance of about 1e-8.

Defined cases: a null or empty text or one without words has an empty set, no links and itself as
component; with one to four words, the whole sequence is the one shingle; rows that share a doc_id are
one document with the least text; a null doc_id is left out; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm import common
from quillgraph.llm.kernels import SLOT, Words, mix, slices

WORDS = 5
PERCENT = 80
#: Hashes that one bucket holds on average.
BUCKET_HASHES = 1_000_000
#: Text whose documents' repeated shingles are put in order together.
HOME_CHARS = 16_000_000
#: Most rounds of trying neighbours in a shuffled order before all remaining pairs are tried.
SHUFFLED_ROUNDS = 3
#: Lists and components up to this size are joined pair by pair; larger ones are worked on in pairs of blocks.
SMALL = 64
#: Entries that one window takes of a list, and classes (and shingles) of one block.
LIST, BLOCK, BLOCK_KEYS = 512, 4096, 1_500_000
_HISTOGRAM, _SLAB = 32, 2048


def shingle_sets(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    words = Words(data, at)
    grams, gram_at = words.grams(WORDS)
    sets = []
    for i in range(len(at) - 1):
        n = words.at[i + 1] - words.at[i]
        if n >= WORDS:
            sets.append(np.unique(grams[gram_at[i] : gram_at[i + 1]]))
        elif n:
            own = words.hash[words.at[i] : words.at[i + 1]] * SLOT[8 : 8 + n]
            sets.append(mix(own.sum(dtype=np.uint64, keepdims=True) + SLOT[15] * np.uint64(n)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _deal(buckets: int):
    """Rows (bucket, payload): the sets' hashes by bucket; each document goes to one bucket at least."""

    def run(batches):
        for batch in batches:
            for part, data, at in slices(batch):
                ids = part.column(0).to_numpy()
                sets = shingle_sets(data, at)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                first: dict[bytes, int] = {}
                for i in np.argsort(ids, kind="stable"):
                    first.setdefault(digests[i], i)
                counted = np.zeros(len(ids), bool)
                counted[list(first.values())] = True
                size = np.array([len(s) for s in sets], np.int64)
                sent = [s if c else s[:0] for s, c in zip(sets, counted, strict=True)]
                hashes = np.concatenate(sent)
                row = np.repeat(np.arange(len(ids)), [len(s) for s in sent])
                bucket = (hashes % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                hashes, row, bucket = (hashes // np.uint64(buckets))[order], row[order], bucket[order]
                home = (mix(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                settled = np.argsort(home, kind="stable")
                some = np.union1d(bucket, home)
                edges = np.stack([np.searchsorted(bucket, some), np.searchsorted(bucket, some, "right"), np.searchsorted(home[settled], some), np.searchsorted(home[settled], some, "right")], 1)
                out: dict[str, list] = {"bucket": [], "ids": [], "counts": [], "sizes": [], "digests": [], "low": [], "high": []}
                for b, (lo, hi, first_home, last_home) in zip(some.tolist(), edges.tolist(), strict=True):
                    here = np.union1d(settled[first_home:last_home], row[lo:hi])
                    out["bucket"].append(b)
                    out["ids"].append(ids[here].tobytes())
                    out["counts"].append(np.bincount(np.searchsorted(here, row[lo:hi]), minlength=len(here)).astype(np.uint32).tobytes())
                    at_home = home[here] == b
                    out["sizes"].append(np.where(at_home, size[here], -1).astype(np.int32).tobytes())
                    out["digests"].append(b"".join(digests[i] for i in here[at_home]))
                    out["low"].append((hashes[lo:hi] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes())
                    out["high"].append(((hashes[lo:hi] >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_pydict(out, schema=_DEALT)

    return run


_DEALT = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("ids", "counts", "sizes", "digests", "low", "high"))])
_DEALT_SQL = "bucket int, ids binary, counts binary, sizes binary, digests binary, low binary, high binary"


def _home(ids: np.ndarray, homes: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(homes)).astype(np.int64)


def _count(table: pa.Table, homes: int) -> pa.Table:
    """For one bucket: each document's repeated hashes with their document frequency, a row for each home."""
    get = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    ids, counts, sizes = get("ids", np.int64), get("counts", np.uint32).astype(np.int64), get("sizes", np.int32)
    digests = get("digests", "V16")
    keys = get("low", np.uint32).astype(np.uint64) | (get("high", np.uint8).astype(np.uint64) << np.uint64(32))
    bucket = table.column("bucket")[0].as_py() if table.num_rows else 0
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.cumsum(new) - 1
    df = np.empty(len(keys), np.int64)
    df[order] = np.bincount(group)[group] if len(group) else 0
    row = np.repeat(np.arange(len(ids)), counts)
    again = df > 1
    row, full, df = row[again], ((np.uint64(bucket) << np.uint64(40)) | keys[again]).astype(np.int64), np.minimum(df[again], 65535).astype(np.uint16)
    number = np.bincount(row, minlength=len(ids))
    keep = np.flatnonzero((sizes >= 0) | (number > 0))
    keep = keep[np.argsort(_home(ids[keep], homes), kind="stable")]
    place = np.empty(len(ids), np.int64)
    place[keep] = np.arange(len(keep))
    order = np.argsort(place[row], kind="stable")
    full, df = full[order], df[order]
    mark = np.cumsum(sizes >= 0) - 1
    at = np.concatenate([[0], np.cumsum(number[keep])])
    some, edges = np.unique(_home(ids[keep], homes), return_index=True)
    runs = list(zip(edges.tolist(), np.append(edges[1:], len(keep)).tolist()))  # none of nothing
    part = lambda x: pa.array([x[i:j].tobytes() for i, j in runs], pa.binary())
    inner = lambda x: pa.array([x[at[i] : at[j]].tobytes() for i, j in runs], pa.binary())
    named = [keep[i:j] for i, j in runs]
    return pa.table(
        {
            "home": pa.array(some.astype(np.int32)),
            "ids": part(ids[keep]),
            "sizes": part(sizes[keep]),
            "counts": part(number[keep].astype(np.uint32)),
            "digests": pa.array([digests[mark[k[sizes[k] >= 0]]].tobytes() for k in named], pa.binary()),
            "keys": inner(full),
            "dfs": inner(df),
        }
    )


_COUNTED_SQL = "home int, ids binary, sizes binary, counts binary, digests binary, keys binary, dfs binary"


def prefix_length(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


_ORDERED = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("digest", pa.binary()), ("r", pa.int32()), ("keys", pa.binary()), ("s1", pa.int64()), ("s2", pa.int64())])


def _packed(keys: np.ndarray) -> tuple[int | None, int | None]:
    """How many keys are in each of 16 hash ranges, a byte each; none if one has over 255."""
    counts = np.bincount((mix(keys.astype(np.uint64)) & np.uint64(15)).astype(np.int64), minlength=16)
    if counts.max() > 255:
        return None, None
    one, two = np.frombuffer(counts.astype(np.uint8).tobytes(), np.int64).tolist()
    return one, two


def _order(table: pa.Table) -> pa.Table:
    """Sort the repeated shingles of each document of a home, rarest first; r of them are in its prefix."""
    get = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    ids, sizes, counts = get("ids", np.int64), get("sizes", np.int32), get("counts", np.uint32)
    digests, keys, df = get("digests", "V16"), get("keys", np.int64), get("dfs", np.uint16)
    docs, where = np.unique(ids, return_inverse=True)
    n, digest = np.zeros(len(docs), np.int64), np.zeros(len(docs), "V16")
    n[where[sizes >= 0]], digest[where[sizes >= 0]] = sizes[sizes >= 0], digests
    row = np.repeat(where, counts)
    order = np.lexsort((keys, df, row))
    row, keys = row[order], keys[order]
    at = np.searchsorted(row, np.arange(len(docs) + 1))
    out: dict[str, list] = {k: [] for k in _ORDERED.names}
    for k, doc in enumerate(docs.tolist()):
        own, size = keys[at[k] : at[k + 1]], int(n[k])
        r = max(0, min(len(own), prefix_length(size) - (size - len(own)))) if size else 0
        while 0 < r < len(own) and own[r] == own[r - 1]:
            r += 1
        for name, value in (("doc_id", doc), ("n", size), ("digest", digest[k].tobytes()), ("r", r), ("keys", own.tobytes() if r else b""), *zip(("s1", "s2"), _packed(own) if r else (None, None), strict=True)):
            out[name].append(value)
    return pa.Table.from_pydict(out, schema=_ORDERED)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _prefix(keys: pd.Series, r: pd.Series) -> pd.Series:
    return pd.Series([np.frombuffer(k, np.int64)[:n] for k, n in zip(keys, r, strict=True)])


def overlap_needed(na, nb):
    """Least intersection with 100 * i >= PERCENT * (na + nb - i)."""
    return (PERCENT * (na + nb) + 99 + PERCENT) // (100 + PERCENT)


@F.pandas_udf(T.BooleanType())
def _linked(ka: pd.Series, na: pd.Series, kb: pd.Series, nb: pd.Series) -> pd.Series:
    out = []
    for x, m, y, n in zip(ka, na, kb, nb, strict=True):
        x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
        need = -(-PERCENT * (int(m) + int(n)) // (100 + PERCENT))
        if min(len(x), len(y)) < need:
            out.append(False)
            continue
        hx, hy = (np.bincount((mix(z.astype(np.uint64)) % np.uint64(_HISTOGRAM)).astype(np.int64), minlength=_HISTOGRAM) for z in (x, y))
        if np.minimum(hx, hy).sum() < need:
            out.append(False)
            continue
        out.append(len(np.intersect1d(x, y)) >= need)
    return pd.Series(out, dtype=bool)


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    a = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("keys").alias("ka"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("keys").alias("kb"))
    return pairs.join(a, "a").join(b, "b").filter(_linked("ka", "na", "kb", "nb")).select("a", "b")


def _passes(left: str, right: str):
    """Length, positional and suffix filters on two entries of one shingle's list.

    A linked pair meets in the list of its first common shingle, before which nothing is common; so
    what is left from there on in either set must reach the overlap. In later lists it needn't pass.
    The suffix filter bounds the overlap by what 16 hash ranges hold in either set.
    """
    n1, n2, p1, p2 = (F.col(f"{s}.{c}") for c in ("n", "pos") for s in (left, right))
    need = F.ceil(PERCENT * (n1 + n2) / (100 + PERCENT) - 1e-9)
    most = F.least(n1 - p1, n2 - p2)
    ranged = F.lit(0)
    for half in ("s1", "s2"):
        for k in range(0, 64, 8):
            ranged = ranged + F.least(*[F.shiftrightunsigned(F.col(f"{s}.{half}"), k).bitwiseAND(F.lit(255)) for s in (left, right)])
    ranged = F.when(F.col(f"{left}.s1").isNull() | F.col(f"{right}.s1").isNull(), need).otherwise(ranged)
    return (100 * F.least(n1, n2) >= PERCENT * F.greatest(n1, n2)) & (most >= need) & (ranged >= need)


def _mixed(lists: DataFrame, found: DataFrame) -> DataFrame:
    """The lists that have entries of different components, with each entry's component and the list's size."""
    placed = lists.select("tok", "e").join(found, F.col("e.doc_id") == F.col("node"), "left").select("tok", "e", F.coalesce("component", F.col("e.doc_id")).alias("comp"))
    mixed = placed.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi").select("tok", "size")
    return common.cut(placed.join(mixed, "tok"))


def _split(lists: DataFrame, turn: int) -> tuple[DataFrame, list[str]]:
    """Long lists in parts of some LIST entries, dealt out by list and part."""
    part = F.pmod(F.xxhash64("e.doc_id", F.lit(turn), F.lit("part")), F.ceil(F.col("size") / LIST))
    return lists.withColumn("part", part).repartition("tok", "part"), ["tok", "part"]


def _pairs(listed: DataFrame) -> DataFrame:
    x, y = F.col("x.doc_id"), F.col("y.doc_id")
    return listed.filter(_passes("x", "y")).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).filter("a <> b").distinct()


def _blocked(rows: DataFrame, doc: Column, blocks: Column) -> DataFrame:
    """Each row once for every pair of blocks that its own block is in; ``block`` is its own, (``lo``, ``hi``) the pair."""
    own = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(doc, F.lit("block")), F.col("blocks")))
    return own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("blocks", "other")


def _across(table: pa.Table) -> pa.Table:
    """(a, b) of two blocks of one list: pairs in different components that pass the filters of ``_passes``."""
    get = lambda name: table.column(name).to_numpy()
    doc, comp, n, pos, block = get("doc_id"), get("comp"), get("n").astype(np.int64), get("pos").astype(np.int64), get("block")
    ranges = np.frombuffer(b"".join(table.column("ranges").to_pylist()), np.uint8).reshape(len(doc), 16).astype(np.int16)
    known = get("known")
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    right = right[np.argsort(n[right], kind="stable")]
    size = n[right]
    out: list[np.ndarray] = []
    for i in left.tolist():
        # Only sizes that the length filter lets pass.
        near = right[np.searchsorted(size, -(-PERCENT * n[i] // 100)) : np.searchsorted(size, 100 * n[i] // PERCENT, "right")]
        near = near[comp[near] != comp[i]]
        if lo == hi:
            near = near[doc[near] > doc[i]]
        need = -(-PERCENT * (n[i] + n[near]) // (100 + PERCENT))
        near, need = (x[np.minimum(n[i] - pos[i], n[near] - pos[near]) >= need] for x in (near, need))
        if known[i] and len(near):
            near = near[~known[near] | (np.minimum(ranges[near], ranges[i]).sum(1) >= need)]
        out.append(np.stack([np.minimum(doc[near], doc[i]), np.maximum(doc[near], doc[i])]))
    found = np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)
    return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})


def _left_pairs(placed: DataFrame) -> DataFrame:
    """Pairs of one list in different components that pass the filters."""
    small = placed.filter(F.col("size") <= SMALL)
    x = small.select("tok", F.col("e").alias("x"), F.col("comp").alias("cx"))
    y = small.select("tok", F.col("e").alias("y"), F.col("comp").alias("cy"))
    large = _blocked(placed.filter(F.col("size") > SMALL), F.col("e.doc_id"), F.ceil(F.col("size") / BLOCK))
    ranges = F.concat(*[F.coalesce(F.reverse(F.unhex(F.lpad(F.hex(f"e.{c}"), 16, "0"))), F.unhex(F.lit("00" * 8))) for c in ("s1", "s2")])
    large = large.select("tok", "lo", "hi", "block", "comp", "e.doc_id", "e.n", "e.pos", ranges.alias("ranges"), F.col("e.s1").isNotNull().alias("known"))
    blocked = large.groupBy("tok", "lo", "hi").applyInArrow(_across, "a bigint, b bigint")
    return _pairs(x.join(y, "tok").filter("cx < cy")).unionByName(blocked).distinct()


def _overlaps(rows: tuple[np.ndarray, ...], columns: tuple[np.ndarray, ...], counts: tuple[int, int]) -> np.ndarray:
    """How many shingles each row of one block shares with each of another."""
    names, code, often = np.unique(np.concatenate(columns), return_inverse=True, return_counts=True)
    place = np.cumsum(often > 1) - 1
    place[often < 2] = -1
    code = place[code]
    parts = [(r[c >= 0], c[c >= 0]) for r, c in zip(rows, (code[: len(columns[0])], code[len(columns[0]) :]), strict=True)]
    parts = [(r[order], c[order]) for r, c in parts for order in [np.argsort(c, kind="stable")]]
    shared = np.zeros(counts, np.float32)
    for low in range(0, int((often > 1).sum()), _SLAB):
        ones = []
        for (r, c), n in zip(parts, counts, strict=True):
            i, j = np.searchsorted(c, [low, low + _SLAB])
            ones.append(np.zeros((n, _SLAB), np.float32))
            ones[-1][r[i:j], c[i:j] - low] = 1
        shared += ones[0] @ ones[1].T
    return shared


def _block_links(table: pa.Table) -> pa.Table:
    """(class_id, links): the links of the classes of two blocks with those of the other block."""
    doc, n, block = (table.column(c).to_numpy() for c in ("doc_id", "n", "block"))
    keys = table.column("keys").to_pylist()
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    sides = [np.flatnonzero(block == lo), np.flatnonzero(block == hi)]
    columns = [np.frombuffer(b"".join(keys[i] for i in side), np.int64) for side in sides]
    rows = [np.repeat(np.arange(len(side)), [len(keys[i]) // 8 for i in side]) for side in sides]
    shared = _overlaps(tuple(rows), tuple(columns), (len(sides[0]), len(sides[1]))).astype(np.int64)
    linked = (100 + PERCENT) * shared >= PERCENT * (n[sides[0]].astype(np.int64)[:, None] + n[sides[1]][None, :])
    if lo == hi:
        np.fill_diagonal(linked, False)
        return pa.table({"class_id": pa.array(doc[sides[0]], pa.int64()), "links": pa.array(linked.sum(1), pa.int64())})
    return pa.table({"class_id": pa.array(np.concatenate([doc[sides[0]], doc[sides[1]]]), pa.int64()), "links": pa.array(np.concatenate([linked.sum(1), linked.sum(0)]), pa.int64())})


def _links(chief: DataFrame, found: DataFrame) -> DataFrame:
    """(class_id, class_links): how many other classes each class is linked to; links don't leave components."""
    sets = chief.join(found.withColumnRenamed("node", "doc_id"), "doc_id").select("doc_id", "n", "keys", "s1", "s2", "component")
    size = found.join(chief.select(F.col("doc_id").alias("node"), "n"), "node").groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"))
    # Of as many blocks as classes or shingles ask for, each has some BLOCK_KEYS shingles at most.
    size = size.withColumn("blocks", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("total") / BLOCK_KEYS)))
    sets = common.cut(sets.join(size.select("component", "size", "blocks"), "component"))
    small = sets.filter(F.col("size") <= SMALL)
    entry = F.struct("n", "doc_id", F.lit(0).alias("pos"), "s1", "s2")
    x, y = (small.select("component", entry.alias(name)) for name in "xy")
    pairs = common.cut(_pairs(x.join(y, "component").filter("x.doc_id < y.doc_id")))
    single = _verify(pairs, small).select(F.explode(F.array("a", "b")).alias("class_id"), F.lit(1).cast("long").alias("links"))
    large = sets.filter(F.col("size") > SMALL).select("component", "doc_id", "n", "keys", "blocks")
    blocked = _blocked(large, F.col("doc_id"), F.col("blocks"))
    counted = blocked.groupBy("component", "lo", "hi").applyInArrow(_block_links, "class_id bigint, links bigint")
    return single.unionByName(counted).groupBy("class_id").agg(F.sum("links").alias("class_links"))


def components(docs: DataFrame, bucket_hashes: int = BUCKET_HASHES, count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, class_links) for every document.

    class_id is the least doc_id with the same set; class_links counts all other classes that its class
    is linked to. Without ``count_links`` it is left out.
    """
    spark = docs.sparkSession
    own = common.numbered_documents(docs)
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(common.partitions(spark), chars // 6 // bucket_hashes + 1)
    dealt = own.mapInArrow(_deal(buckets), _DEALT_SQL)
    homes = max(common.partitions(spark), chars // HOME_CHARS + 1)
    counted = dealt.groupBy("bucket").applyInArrow(lambda table: _count(table, homes), _COUNTED_SQL)
    sets = common.cut(counted.groupBy("home").applyInArrow(_order, "doc_id bigint, n int, digest binary, r int, keys binary, s1 bigint, s2 bigint"))
    known = sets.filter("n > 0")
    # Classes: equal digests. The members that a slice of input saw first hold the keys; the least doc_id always does.
    # They are written out first, so that the join below is one of plain exchanges, whose large keys can be split.
    classes = common.cut(known.groupBy("digest").agg(F.min("doc_id").alias("class_id")))
    member = common.cut(sets.select("doc_id", "n", "digest").join(classes, "digest", "left").select("doc_id", "n", F.coalesce("class_id", "doc_id").alias("class_id")))
    chief = sets.join(member.filter("doc_id = class_id").select("doc_id"), "doc_id", "left_semi").filter("r > 0").select("doc_id", "n", "r", "keys", "s1", "s2", (F.col("n") - F.length("keys") / 8).cast("int").alias("single"))
    lists = chief.select("doc_id", "n", "single", "s1", "s2", F.posexplode(_prefix("keys", "r")).alias("i", "tok")).select("tok", F.struct("n", "doc_id", (F.col("single") + F.col("i")).alias("pos"), "s1", "s2").alias("e"))
    lists = common.cut(lists)
    shared = common.cut(lists.groupBy("tok").agg(F.count(F.lit(1)).alias("size"), F.min("e").alias("head")).filter("size > 1"))
    lists = common.cut(lists.join(shared, "tok"))

    parts, by = _split(lists, -1)
    near = parts.select(F.col("e").alias("y"), F.lag("e").over(Window.partitionBy(*by).orderBy("e")).alias("before"), "head")
    near = near.select("y", F.explode(F.array("before", "head")).alias("x")).filter("x is not null")
    tried = common.cut(_pairs(near))
    found = common.connected_components(common.cut(_verify(tried, chief)))

    # Neighbours in other orders, as long as that joins components: a few entries for each one of a list.
    for turn in range(SHUFFLED_ROUNDS):
        lists = _mixed(lists, found)  # lists of one component stay so
        parts, by = _split(lists, turn)
        shuffled = Window.partitionBy(*by).orderBy(F.xxhash64("e.doc_id", F.lit(turn)), "e.doc_id")
        near = parts.select(F.col("e").alias("y"), F.col("comp").alias("cy"), F.array(*[F.lag(F.struct("e", "comp"), k).over(shuffled) for k in (1, 2, 3)]).alias("near"))
        near = near.select("y", "cy", F.explode("near").alias("near")).filter("near.comp <> cy").select("y", F.col("near.e").alias("x"))
        fresh = common.cut(_pairs(near).join(tried, ["a", "b"], "left_anti"))
        more = common.cut(_verify(fresh, chief))
        tried = tried.unionByName(fresh)
        if not more.limit(1).count():
            break
        found = common.merge_components(found, more)

    # What is left: all pairs of one list in different components.
    fresh = common.cut(_left_pairs(_mixed(lists, found)).join(tried, ["a", "b"], "left_anti"))
    more = common.cut(_verify(fresh, chief))
    if more.limit(1).count():
        found = common.merge_components(found, more)
    out = ["doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "class_id").alias("component_id"), "class_id"]
    if count_links:
        found = found.join(_links(chief, found).withColumnRenamed("class_id", "node"), "node", "left")
        out.append(F.coalesce("class_links", F.lit(0)).alias("class_links"))
    return member.join(found.withColumnRenamed("node", "class_id"), "class_id", "left").select(*out)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have the least doc_id of their component, with all their columns.

    All rows of that doc_id stay, for they are one document; rows without a doc_id can't be judged and go.
    """
    kept = components(docs, count_links=False).filter("doc_id = component_id").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(common.table(spark, sf_dir, "documents"))

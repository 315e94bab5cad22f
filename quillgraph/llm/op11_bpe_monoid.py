"""Byte-level BPE by monoid tree reduction, encoding and decoding.

Encodings of neighbouring strings join associatively, so a string is cut into halves, the halves are encoded and joined,
at three sizes:

* the bytes of one match of the split pattern: halves down to ``BASE_BYTES``, merged directly there. A join encodes the last
  tokens of the left half and the first of the right one anew, and doubles the window on a side until the token
  outside and the window's outermost token are what their own bytes are encoded to. A sequence whose
  neighbours all fit in this way is the encoding of its bytes, so nothing outside the window can change.
* leaves of a long text: texts over ``LEAF_CHARS`` are cut into leaves, which Spark deals out as rows of their own. A leaf is
  split by the pattern as if it stood alone. A join splits the end of the left leaf and the start of the right
  one anew, and doubles the window until it reaches a bound between matches that the right leaf has too and that lies three
  characters or more inside the window: the pattern looks at most two characters past the end of a match and never back.
* the leaves of a document come together by doc_id, a row or two for 32,768 characters, and are joined pairwise.

Decoding maps ids to bytes, and the parts are concatenated.

Each worker remembers the ids of short matches, ``MEMO`` at most. Only long texts are shuffled, once.

Defined cases: a null or empty text has no ids; rows that share a doc_id are one document with the least text; a null
doc_id is left out; other columns are ignored, whatever their names; an empty table gives no rows; a match that is a token as a whole is that token.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import common
from quillgraph.llm.kernels import slices

BASE_BYTES = 16
LEAF_CHARS = 1 << 15
#: Matches that a worker remembers, and the longest of them.
MEMO, MEMO_CHARS = 1 << 19, 48
#: Characters that a match may be decided by beyond its end, and one more.
AHEAD = 3
#: Ids decoded at once.
DECODE_IDS = 1 << 18


def default_vocabulary() -> tuple[str, str]:
    """The rank file and the split pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


class Merges:
    """The monoid of token sequences under one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._fits: dict[tuple[int, int], bool] = {}

    def merge(self, raw: bytes) -> list[int]:
        """Merges the pair of lowest rank, the leftmost of equals, until none is left."""
        return self._merge_heap(raw) if len(raw) > 256 else self._merge_scan(raw)

    def _merge_scan(self, raw: bytes) -> list[int]:
        get, none = self.ranks.get, len(self.ranks) + (1 << 32)
        parts = [raw[i : i + 1] for i in range(len(raw))]
        pairs = [get(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def _merge_heap(self, raw: bytes) -> list[int]:
        n, get = len(raw), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live = [True] * n
        heap = [(r, i, 2) for i in range(n - 1) if (r := get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = end[i]
            if not live[i] or j >= n or end[j] - i != size:
                continue
            live[j], end[i] = False, end[j]
            if end[i] < n:
                before[end[i]] = i
            for a in (before[i], i):
                if a >= 0 and end[a] < n:
                    b = end[end[a]]
                    if (r := get(raw[a:b])) is not None:
                        heapq.heappush(heap, (r, a, b - a))
        return [self.ranks[raw[i : end[i]]] for i in range(n) if live[i]]

    def fit(self, a: int, b: int) -> bool:
        """Whether the bytes of the two tokens are encoded to them."""
        found = self._fits.get((a, b))
        if found is None:
            if len(self._fits) >= MEMO:
                self._fits.clear()
            found = self._fits[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left or right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merge(b"".join([self.bytes_of[x] for x in (*left[len(left) - i :], *right[:j])]))
            on_left = i == len(left) or self.fit(left[-i - 1], window[0])
            on_right = j == len(right) or self.fit(window[-1], right[j])
            if on_left and on_right:
                return [*left[: len(left) - i], *window, *right[j:]]
            i, j = i if on_left else 2 * i, j if on_right else 2 * j

    def encode(self, raw: bytes) -> list[int]:
        if len(raw) <= BASE_BYTES:
            return self.merge(raw)
        half = len(raw) // 2
        return self.join(self.encode(raw[:half]), self.encode(raw[half:]))


class _Memo(dict):
    """Ids of matches as bytes."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, match: str) -> bytes:
        raw = match.encode()
        whole = self.merges.ranks.get(raw)
        ids = array("I", [whole] if whole is not None else self.merges.encode(raw)).tobytes()
        if len(match) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[match] = ids
        return ids


class Part:
    """A stretch of text: its matches' lengths in characters and in ids, and the ids."""

    def __init__(self, text: str, chars: np.ndarray, counts: np.ndarray, ids: np.ndarray):
        self.text, self.chars, self.counts, self.ids = text, chars, counts, ids

    def sizes(self) -> bytes:
        return np.stack([self.chars, self.counts]).astype("<i8").tobytes()

    @classmethod
    def of(cls, text: str, sizes: bytes, ids: bytes) -> Part:
        return cls(text, *np.frombuffer(sizes, "<i8").reshape(2, -1), np.frombuffer(ids, "<u4"))


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merges = Merges(ranks)
        self.split = regex.compile(pattern).findall
        self.memo = _Memo(self.merges)
        top = max(ranks.values()) + 1
        self.token_size = np.zeros(top, np.int64)
        self.token_size[list(ranks.values())] = [len(b) for b in ranks]
        self.token_at = np.concatenate([[0], np.cumsum(self.token_size)])
        self.token_bytes = np.frombuffer(b"".join(self.merges.bytes_of.get(i, b"") for i in range(top)), np.uint8)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.split(text)))

    def leaf(self, text: str) -> Part:
        matches = self.split(text)
        ids = [self.memo[m] for m in matches]
        return Part(text, np.array([*map(len, matches)], np.int64), np.array([*map(len, ids)], np.int64) // 4, np.frombuffer(b"".join(ids), "<u4"))

    def join(self, left: Part, right: Part) -> Part:
        left_end, right_end = np.cumsum(left.chars), np.cumsum(right.chars)
        keep = int(np.searchsorted(left_end, len(left.text) - AHEAD, "right"))
        tail = left.text[int(left_end[keep - 1]) if keep else 0 :]
        size, skip = 64, None
        while skip is None:
            whole = size >= len(right.text)
            matches = self.split(tail + right.text[:size])
            at = np.cumsum([len(m) for m in matches]) - len(tail)
            place = np.searchsorted(right_end, at)  # the right part's match that ends there, if one does
            same = (at == 0) | ((at > 0) & (right_end[np.minimum(place, len(right_end) - 1)] == at))
            found = np.flatnonzero(same & (whole | (at <= size - AHEAD)))
            if len(found):
                skip = 0 if at[found[0]] == 0 else int(place[found[0]]) + 1
                matches = matches[: found[0] + 1]
            size *= 2
        middle = [self.memo[m] for m in matches]
        return Part(
            left.text + right.text,
            np.concatenate([left.chars[:keep], np.array([*map(len, matches)], np.int64), right.chars[skip:]]),
            np.concatenate([left.counts[:keep], np.array([*map(len, middle)], np.int64) // 4, right.counts[skip:]]),
            np.concatenate([left.ids[: left.counts[:keep].sum()], np.frombuffer(b"".join(middle), "<u4"), right.ids[right.counts[:skip].sum() :]]),
        )

    def reduce(self, parts: list[Part]) -> Part:
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def decode(self, ids: bytes) -> Iterator[bytes]:
        """The bytes of the ids, in runs of bounded length."""
        every = np.frombuffer(ids, "<u4")
        for i in range(0, len(every), DECODE_IDS):
            some = every[i : i + DECODE_IDS]
            size = self.token_size[some]
            end = np.cumsum(size)
            yield self.token_bytes[np.repeat(self.token_at[some] - end + size, size) + np.arange(end[-1])].tobytes()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One for each worker process."""
    with open(path, "rb") as lines:
        return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


def _encode_short(path: str, pattern: str):
    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            for rows, _, _ in slices(batch):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([own.encode(x) for x in rows.column("text").to_pylist()], pa.binary())], names=["doc_id", "ids"])

    return run


def _leaves(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            doc, text = batch.column("doc_id")[i], batch.column("text")[i].as_py()
            for at in range(0, len(text), LEAF_CHARS):
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()], pa.int64()), pa.array([at // LEAF_CHARS], pa.int64()), pa.array([text[at : at + LEAF_CHARS]])], names=["doc_id", "leaf", "text"])


def _encode_leaves(path: str, pattern: str):
    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            for rows, _, _ in slices(batch):
                made = [own.leaf(x) for x in rows.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([p.sizes() for p in made], pa.binary()), pa.array([p.ids.tobytes() for p in made], pa.binary())], names=["doc_id", "leaf", "text", "sizes", "ids"])

    return run


def _reduce(path: str, pattern: str):
    def run(key: tuple, leaves: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.sort_values("leaf")
        root = codec(path, pattern).reduce([Part.of(*x) for x in zip(leaves["text"], leaves["sizes"], leaves["ids"], strict=True)])
        return pd.DataFrame({"doc_id": [key[0]], "ids": [root.ids.tobytes()]})

    return run


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) of every document; ids are little-endian unsigned 32-bit integers."""
    known = default_vocabulary()
    path, pattern = path or known[0], pattern or known[1]
    own = common.numbered_documents(docs)
    long = F.char_length("text") > LEAF_CHARS
    short = own.filter(~long).mapInArrow(_encode_short(path, pattern), "doc_id bigint, ids binary")
    leaves = own.filter(long).mapInArrow(_leaves, "doc_id bigint, leaf bigint, text string").repartition("doc_id", "leaf")
    parts = leaves.mapInArrow(_encode_leaves(path, pattern), "doc_id bigint, leaf bigint, text string, sizes binary, ids binary")
    return short.unionByName(parts.groupBy("doc_id").applyInPandas(_reduce(path, pattern), "doc_id bigint, ids binary"))


def decode(rows: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) with ``decoded``, the bytes of the ids."""
    known = default_vocabulary()
    path, pattern = path or known[0], pattern or known[1]

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                few = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*few.columns, pa.array([b"".join(own.decode(x)) for x in few.column("ids").to_pylist()], pa.binary())], names=["doc_id", "ids", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids binary, decoded binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode(encode(common.table(spark, sf_dir, "documents")))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""Token ids in binary files: documents in ascending doc_id order, blocks under a range coder.

Files are Parquet tables written by Spark's own committed writers into the shared folder: one row for each
block, with ``part`` and ``seq`` for its place, ``ids`` for its number of ids, ``start`` for the number of ids
before it in its part, and ``block``. A block is a document table (doc_id, piece, number of ids) and an independent,
checksummed code of the ids (see range_coder). Small documents share a block; longer ones than a block
are cut into pieces with a block each. The library encodes distinct words, and a worker remembers those it has met (see Words).

Parts are ranges of doc_id, so a task tokenizes and codes its own documents only; the ids before a part are summed
over the files' block rows, one number for each part.

Defined cases: a null or empty text has the end id alone; rows that share a doc_id are one document with the
least text; a null doc_id is left out; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm import common, range_coder
from quillgraph.llm.kernels import slices

END_ID = 2
#: Text tokenized at once, and text whose blocks are coded in step.
TOKENIZE_BYTES, CODE_BYTES = 1 << 20, 6 << 20
#: Words of each of the two tables that a worker remembers (a slice may add its own), and the longest of them.
KNOWN_WORDS, KNOWN_CHARS = 1 << 17, 32
#: Words that the library encodes at once.
NEW_WORDS = 2000
PART_BYTES = 64 << 20

_ROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("ids", pa.int64()), ("block", pa.binary())])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """One for each worker process: loading it for each task leaves memory in pieces."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_SPACE, _LETTER, _NUMBER, _OTHER, _UNKNOWN = range(5)
#: Codes after an apostrophe that end a word with it, each with the length of that word.
_SHORT = (("s", 2), ("t", 2), ("re", 3), ("ve", 3), ("m", 2), ("ll", 3), ("d", 2))
_QUOTE, _BLANK = 39, 32


class Words:
    """The tokenizer over distinct words: a slice is cut into words as the ByteLevel step cuts it, equal words are found by Arrow,
    and the library encodes those that the worker doesn't remember.

    What a character counts as is asked of the library. Texts that hold an added token, and all texts if the tokenizer
    has other steps than this one, are encoded by the library whole.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        kinds = json.loads(self.tokenizer.to_str())
        step = kinds["pre_tokenizer"] or {}
        others = [kinds.get(k) for k in ("normalizer", "post_processor", "truncation", "padding")]
        self.plain = step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space") and not any(others)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.full(0x110000, _UNKNOWN, np.uint8)
        #: Ids of words by use: what isn't used again goes with ``older``.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _kinds(self, codes: np.ndarray) -> np.ndarray:
        found = self.kind[codes]
        if (found == _UNKNOWN).any():
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
            for c in np.unique(codes[found == _UNKNOWN]).tolist():
                alone = [k for k, before in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")) if len(cut(before + chr(c))) == 1]
                self.kind[c] = alone[0] if alone else _SPACE
            found = self.kind[codes]
        return found

    def starts(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether a word starts at each character; ``first`` marks the first ones of texts."""
        kind = self._kinds(codes)
        space = kind == _SPACE
        out = first.copy()
        out[1:] |= (kind[1:] != kind[:-1]) & ~(~space[1:] & (codes[:-1] == _BLANK))
        # The last of several spaces stands alone or goes to what follows.
        out[1:-1] |= space[:-2] & space[1:-1] & ~space[2:] & ~first[2:]
        quote = np.flatnonzero(out & (codes == _QUOTE))
        for tail, size in _SHORT:
            own = quote[quote + size <= len(codes)]
            for k, c in enumerate(tail, 1):
                own = own[(codes[own + k] == ord(c)) & ~first[own + k]]
            out[own + 1] = False
            own = own[own + size < len(codes)]
            out[own + size] = True
        return out

    def _new(self, words: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(words), NEW_WORDS):
            coded = self.tokenizer.encode_batch_fast(words[i : i + NEW_WORDS], add_special_tokens=False)
            out += [array("I", c.ids).tobytes() for c in coded]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        hard = [i for i, t in enumerate(texts) if not self.plain or any(a in t for a in self.added)]
        out = self._encode_plain(["" if i in (own := set(hard)) else t for i, t in enumerate(texts)] if hard else texts) if self.plain else [np.zeros(0, np.uint32)] * len(texts)
        for i, c in zip(hard, self.tokenizer.encode_batch_fast([texts[i] for i in hard], add_special_tokens=False), strict=True):
            out[i] = np.array(c.ids, np.uint32)
        return out

    def _encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        whole = "".join(texts)
        if not whole:
            return [np.zeros(0, np.uint32)] * len(texts)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        at = np.cumsum([0, *map(len, texts)])
        first = np.zeros(len(codes), bool)
        first[at[:-1][at[:-1] < len(codes)]] = True
        start = np.flatnonzero(self.starts(codes, first))
        size = np.ones(len(codes), np.uint8)
        for least in (0x80, 0x800, 0x10000):
            size += codes >= least
        byte = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.append(start, len(codes))]
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(byte), pa.py_buffer(whole.encode())).dictionary_encode()
        which, distinct = words.indices.to_numpy(), words.dictionary.to_pylist()
        ids = [*map(self.known.get, distinct)]
        absent = [i for i, x in enumerate(ids) if x is None]
        for i in absent:
            ids[i] = self.older.get(distinct[i])
        missing = [i for i in absent if ids[i] is None]
        for i, x in zip(missing, self._new([distinct[i] for i in missing]), strict=True):
            ids[i] = x
        self.known.update((distinct[i], ids[i]) for i in absent if len(distinct[i]) <= KNOWN_CHARS)
        if len(self.known) > KNOWN_WORDS:
            self.known, self.older = {}, self.known
        flat = np.frombuffer(b"".join(ids), np.uint32)
        count = np.array([*map(len, ids)], np.int64) // 4
        own, begin = count[which], (np.cumsum(count) - count)[which]
        end = np.concatenate([[0], np.cumsum(own)])
        every = flat[np.repeat(begin - end[:-1], own) + np.arange(end[-1])]
        bounds = end[np.searchsorted(start, at)].tolist()
        return [every[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(path)


def _pack(docs: list[tuple[int, np.ndarray]]):
    """(document table, ids) of each block."""
    size = range_coder.BLOCK_IDS
    table: list[tuple[int, int, int]] = []
    held: list[np.ndarray] = []
    n = 0
    for doc, ids in docs:
        if n + len(ids) > size and n:
            yield table, np.concatenate(held)
            table, held, n = [], [], 0
        for piece, at in enumerate(range(0, len(ids), size)):
            part = ids[at : at + size]
            table.append((doc, piece, len(part)))
            held.append(part)
            n += len(part)
            if n >= size or len(ids) > size:
                yield table, np.concatenate(held)
                table, held, n = [], [], 0
    if n:
        yield table, np.concatenate(held)


def _write(path: str):
    def run(batches):
        words = _words(path)
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for rows, _, _ in slices(batch, limit=CODE_BYTES):
                docs = []
                for few, _, _ in slices(rows, limit=TOKENIZE_BYTES):
                    coded = words.encode(few.column("text").to_pylist())
                    docs += [(d, np.append(c, np.uint32(END_ID))) for d, c in zip(few.column("doc_id").to_pylist(), coded, strict=True)]
                blocks = list(_pack(docs))
                out: dict[str, list] = {k: [] for k in _ROW.names}
                for (table, ids), code in zip(blocks, range_coder.encode([b[1] for b in blocks]), strict=True):
                    head = struct.pack("<I", len(table)) + np.array(table, "<i8").tobytes()
                    for k, v in (("part", part), ("seq", seq), ("start", start), ("ids", len(ids)), ("block", head + code)):
                        out[k].append(v)
                    seq, start = seq + 1, start + len(ids)
                yield pa.RecordBatch.from_pydict(out, schema=_ROW)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Write the token files of ``docs`` to ``path``, which must not exist."""
    spark = docs.sparkSession
    own = common.numbered_documents(docs)
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(common.partitions(spark), total // PART_BYTES + 1)
    ordered = own.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_write(tokenizer or default_tokenizer()), "part int, seq int, start bigint, ids bigint, block binary").write.option("compression", "none").parquet(path)


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary())])


def _decode(with_ids: bool):
    def flush(rows):
        out: dict[str, list] = {k: [] for k in _PIECE.names}
        tables = []
        for r in rows:
            n = struct.unpack("<I", r["block"][:4])[0]
            tables.append((np.frombuffer(r["block"], "<i8", 3 * n, 4).reshape(n, 3), r["block"][4 + 24 * n :]))
        for r, (table, _), ids in zip(rows, tables, range_coder.decode([code for _, code in tables]), strict=True):
            at = 0
            for doc, piece, n in table.tolist():
                raw = ids[at : at + n].astype("<u4").tobytes()
                for k, v in (("doc_id", doc), ("piece", piece), ("part", r["part"]), ("start", r["start"] + at), ("n", n), ("crc", zlib.crc32(raw)), ("ids", raw if with_ids else None)):
                    out[k].append(v)
                at += n
        return pa.RecordBatch.from_pydict(out, schema=_PIECE)

    def run(batches):
        held: list = []
        for batch in batches:
            for at in range(0, batch.num_rows, range_coder.LANES):
                held += batch.slice(at, range_coder.LANES).to_pylist()
                if len(held) >= range_coder.LANES:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)

    return run


def _times(matrix: list[int], value: int) -> int:
    out = i = 0
    while value:
        if value & 1:
            out ^= matrix[i]
        value >>= 1
        i += 1
    return out


@cache
def _zero_bits(k: int) -> list[int]:
    """What 2 ** k zero bits do to a CRC-32; one matrix for each bit of a length."""
    half = _zero_bits(k - 1) if k else []
    return [_times(half, x) for x in half] if k else [0xEDB88320, *(1 << i for i in range(31))]


def crc32_joined(first: int, second: int, length: int) -> int:
    """CRC-32 of a string from those of its two parts, the second of ``length`` bytes."""
    bits = 8 * length
    for k in range(bits.bit_length()):
        if bits >> k & 1:
            first = _times(_zero_bits(k), first)
    return first ^ second


@F.pandas_udf(T.LongType())
def _joined_crc(pieces: pd.Series) -> pd.Series:
    out = []
    for own in pieces:
        own = sorted((p["piece"], p["n"], p["crc"]) for p in own)
        crc = own[0][2]
        for _, n, c in own[1:]:
            crc = crc32_joined(crc, c, 4 * n)
        out.append(crc)
    return pd.Series(out, dtype="int64")


def read_pieces(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, part, start, n, crc, ids) decoded from the files; ids are little-endian 32-bit integers."""
    schema = "doc_id bigint, piece bigint, part int, start bigint, n bigint, crc bigint, ids binary"
    return spark.read.parquet(path).select("part", "start", "block").mapInArrow(_decode(with_ids), schema)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in the files."""
    totals = spark.read.parquet(path).groupBy("part").agg(F.sum("ids").alias("ids")).orderBy("part").collect()  # a row for each part
    before, offsets = 0, []
    for r in totals:
        offsets.append((r["part"], before))
        before += r["ids"]
    at = spark.createDataFrame(offsets, "part int, before bigint")
    pieces = read_pieces(spark, path, with_ids=False)
    docs = pieces.groupBy("doc_id").agg(
        F.min("part").alias("part"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.min("crc").alias("crc"), F.count(F.lit(1)).alias("k"), F.collect_list(F.struct("piece", "n", "crc")).alias("pieces")
    )
    docs = common.cut(docs)
    short = docs.filter("k = 1").select("doc_id", "part", "start", "n_tokens", F.col("crc").alias("ids_crc32"))
    long = docs.filter("k > 1").select("doc_id", "part", "start", "n_tokens", _joined_crc("pieces").alias("ids_crc32"))
    return short.unionByName(long).join(F.broadcast(at), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def tokens(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the files of ``docs`` into the shared folder and return what reading them back gives."""
    spark = docs.sparkSession
    path = f"{common.shared_dir(spark)}/quillgraph-tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer)
    return read_index(spark, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(common.table(spark, sf_dir, "documents"))

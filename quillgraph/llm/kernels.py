"""Vectorised byte, word and n-gram hashing over Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text worked on at once: the working arrays are some 100 bytes for each.
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Hashes are polynomials modulo a prime in two independent random bases (a power of two as modulus would let
#: structured strings collide in any base): two strings of n bytes collide with a chance of (n / 2**31) ** 2 at most.
PRIME, BITS = np.uint64(2**31 - 1), np.uint64(31)
_rng = np.random.default_rng(20240607)
BASES = [int(x) for x in _rng.integers(2**29, 2**31 - 2, 2)]
BYTE_CODE = _rng.integers(1, 2**31 - 1, (2, 256), dtype=np.uint64)
SLOT = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[tuple[int, int], np.ndarray] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    return (x & PRIME) + (x >> BITS)


def residue(x: np.ndarray) -> np.ndarray:
    """``x`` modulo PRIME, for any 64 bits."""
    x = _fold(_fold(_fold(x)))
    return x - PRIME * (x >= PRIME)


def powers(n: int, k: int, sign: int) -> np.ndarray:
    """BASES[k] ** (sign * i) modulo PRIME for i up to n."""
    if len(_powers.get((k, sign), ())) <= n:
        own = np.ones(1, np.uint64)
        while len(own) <= max(n, SLICE_BYTES):
            step = pow(BASES[k], sign * len(own), int(PRIME))
            own = np.concatenate([own, residue(own * np.uint64(step))])
        _powers[k, sign] = own
    return _powers[k, sign]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, a row for each base; ``substring`` takes differences of them."""
    out = np.zeros((2, len(data) + 1), np.uint64)
    for k in range(2):
        np.cumsum(_fold(BYTE_CODE[k][data] * powers(len(data), k, 1)[: len(data)]), out=out[k, 1:])
    return out


def substring(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] in 62 bits, the same wherever that content stands."""
    one, two = (residue(residue(prefix[k][end] - prefix[k][start]) * powers(prefix.shape[1], k, -1)[start]) for k in range(2))
    return (one << BITS) | two


_ROLL = np.uint64(0x9E3779B97F4A7C15)


def rolling(data: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of ``n`` bytes, the same for equal runs. It chooses places only: different runs may share one."""
    held = BYTE_CODE[0][data]
    out, size, at, step = np.zeros(max(0, len(data) - n + 1), np.uint64), 1, 0, _ROLL
    while len(out):
        if n & size:
            out = out * step + held[at : at + len(out)]
            at += size
        if 2 * size > n:
            break
        held = held[: len(held) - size] * step + held[size:]
        size, step = 2 * size, np.uint64(int(step) ** 2 % 2**64)
    return mix(out)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows with about ``limit`` bytes of text each."""
    data, at = column_bytes(batch.column(batch.schema.get_field_index(text)))
    i, n = 0, batch.num_rows
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1))
        yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


class Words:
    """The words of a slice: byte bounds, hashes (A-Z lower-cased) and each row's first word."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        solid = ~SPACE[data]
        first = np.zeros(len(data) + 1, bool)
        first[at[:-1]] = True
        start = solid.copy()
        if len(data):
            start[1:] &= ~solid[:-1] | first[1:-1]
        last = solid.copy()
        if len(data):
            last[:-1] &= ~solid[1:] | first[1:-1]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(last) + 1
        self.hash = mix(substring(prefix_hash(LOWER[data]), self.start, self.end))
        self.at = np.searchsorted(self.start, at)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words within a row, and the rows' offsets into them."""
        counts = np.maximum(np.diff(self.at) - (n - 1), 0)
        row_at = np.concatenate([[0], np.cumsum(counts)])
        total = len(self.hash) - n + 1
        if total <= 0 or not row_at[-1]:
            return np.zeros(0, np.uint64), row_at
        joined = self.hash[:total] * SLOT[0]
        for k in range(1, n):
            joined = joined + self.hash[k : k + total] * SLOT[k]
        where = np.arange(row_at[-1]) + np.repeat(self.at[:-1] - row_at[:-1], counts)
        return mix(joined[where]), row_at


def map_rows(df: DataFrame, add: list[tuple[str, T.DataType]], work: Callable, text: str = "text") -> DataFrame:
    """``df`` with the columns ``add``, which ``work(batch, data, at)`` makes for each slice of rows."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in add)])
    kinds = [pa.field(n, _arrow(t)) for n, t in add]

    def run(batches):
        for batch in batches:
            for part, data, at in slices(batch, text):
                made = work(part, data, at)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array(x, k.type) for x, k in zip(made, kinds, strict=True))],
                    schema=pa.schema([*part.schema, *kinds]),
                )

    return df.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    simple = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    return simple[kind.simpleString()]

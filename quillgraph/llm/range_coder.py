"""Blocks of token ids under an adaptive context-mixing range coder.

A block holds up to BLOCK_IDS ids and is coded on its own: it starts from an empty model and ends with a
CRC-32. Its header lists its distinct ids with their counts; the coder then works on their ranks.

The model mixes three predictions into one distribution for each id:
  order 0: the counts of the block's header, in total t;
  order 1: the rank that followed the same rank last time;
  order 2: the rank that followed the same two ranks last time (by a hash of them).
A prediction of order 1 or 2 adds the mass t * hits // misses to its rank, where hits and misses tell how
predictions of that order and of as long a row of successes have fared in the block so far (misses start
at 1). So weights adapt at each id. A mass is at most LIMIT. The two masses stand before the counts of order 0,
and a rank is coded in the first of its intervals, which spares the decoder from merging them.

Many blocks are coded in step, one NumPy lane each, for the work at each id is sequential. The coder is a
carry-less range coder of 48 bits that puts out 16 bits at a time; quotients of such numbers are exact in doubles.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK_IDS = 2048
LANES = 2048
MAGIC = b"QGR2"
LIMIT = 1 << 13
HASH_BITS = 11
#: Successes in a row up to 3, and the state of a place where nothing has been seen.
STATES, UNSEEN = 8, 4
_WHOLE, _TOP, _BOTTOM = (1 << 48) - 1, 1 << 32, 1 << 16


def _floor(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a // b for 0 <= a < 2**53 and b > 0."""
    return (a / b).astype(np.int64)


class _Model:
    """The adaptive state of as many blocks as there are lanes, longest block first; tables are flat.

    Arrays of two rows hold order 2 first, then order 1.
    """

    def __init__(self, counts: list[np.ndarray], size: np.ndarray, slots: bool):
        n = len(counts)
        kinds = np.array([len(c) for c in counts])
        width = int(kinds.max(initial=1))
        self.count = np.zeros((n, width), np.int32)
        for lane, c in enumerate(counts):
            self.count[lane, : len(c)] = c
        self.before = np.cumsum(self.count, 1, dtype=np.int32) - self.count
        #: The rank of each number below t, for the decoder.
        self.slot, self.deep = None, int(size.max(initial=1))
        if slots:
            self.slot = np.zeros((n, self.deep), np.int16)
            for lane, c in enumerate(counts):
                self.slot[lane, : size[lane]] = np.repeat(np.arange(len(c), dtype=np.int16), c)
            self.slot = self.slot.ravel()
        self.count, self.before = self.count.ravel(), self.before.ravel()
        self.total = size.astype(np.int64)
        #: STATES times the rank that followed, plus the state.
        self.table = np.full((n << HASH_BITS) + n * width, UNSEEN - STATES, np.int16)
        lane = np.arange(n)
        self.at_hash, self.at_rank, self.at_width = lane << HASH_BITS, (n << HASH_BITS) + lane * width, lane * width
        self.at_slot = lane * self.deep
        self.at_state = np.stack([lane * STATES, (n + lane) * STATES])
        #: Hits times 2**16, plus misses. What is unseen is never a hit, so its mass is 0.
        self.fared = np.ones(2 * n * STATES, np.int64)
        self.last, self.prior = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def predict(self, n: int) -> None:
        """Guesses and masses for the first ``n`` lanes."""
        last = self.last[:n]
        self.place = np.empty((2, n), np.int64)
        np.add(self.at_hash[:n], ((self.prior[:n] * 40503 + last * 9973) >> 2) & ((1 << HASH_BITS) - 1), out=self.place[0])
        np.add(self.at_rank[:n], last, out=self.place[1])
        entry = self.table[self.place]
        self.guess, self.state = entry >> 3, entry & (STATES - 1)
        self.at = self.at_state[:, :n] + self.state
        self.seen = self.fared[self.at]
        self.mass = np.minimum(_floor(self.total[:n] * (self.seen >> 16), self.seen & 0xFFFF), LIMIT)
        twice = self.mass[1] * (self.guess[0] == self.guess[1])
        self.mass[0] += twice
        self.mass[1] -= twice
        self.both = self.mass[0] + self.mass[1]
        self.whole = self.total[:n] + self.both

    def interval(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = (self.guess == rank) & (self.mass > 0)
        place = self.at_width[: len(rank)] + rank
        start = np.where(own[0], 0, np.where(own[1], self.mass[0], self.both + self.before[place]))
        return start, np.where(own[0], self.mass[0], np.where(own[1], self.mass[1], self.count[place]))

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rank whose interval holds ``value``, and that interval."""
        n = len(value)
        first, second = value < self.mass[0], value < self.both
        rank = self.slot[self.at_slot[:n] + np.maximum(value - self.both, 0)]
        rank = np.where(first, self.guess[0], np.where(second, self.guess[1], rank)).astype(np.int64)
        place = self.at_width[:n] + rank
        start = np.where(first, 0, np.where(second, self.mass[0], self.both + self.before[place]))
        return rank, start, np.where(first, self.mass[0], np.where(second, self.mass[1], self.count[place]))

    def learn(self, rank: np.ndarray) -> None:
        n = len(rank)
        right = self.guess == rank
        self.fared[self.at] = self.seen + 1 + right * 0xFFFF
        self.table[self.place] = rank * STATES + np.minimum(self.state + 1, 3) * right
        self.prior[:n] = self.last[:n]
        self.last[:n] = rank


def _settled(low: np.ndarray, span: np.ndarray):
    """Rounds of the lanes that put out their top 16 bits, with these; ``low`` and ``span`` are brought forward.

    The span is cut where a carry would be possible.
    """
    which = np.flatnonzero(((low ^ (low + span)) < _TOP) | (span < _BOTTOM))
    while len(which):
        own, wide = low[which], span[which]
        wide = np.where((own ^ (own + wide)) < _TOP, wide, -own & (_BOTTOM - 1))
        yield which, own >> 32
        own, wide = (own << 16) & _WHOLE, wide << 16
        low[which], span[which] = own, wide
        which = which[((own ^ (own + wide)) < _TOP) | (wide < _BOTTOM)]


def _steps(size: np.ndarray) -> np.ndarray:
    """The number of lanes that have an id at each step; sizes are descending."""
    return np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")


def _encode_lanes(blocks: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, bytes]]:
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    size = np.array([len(blocks[i]) for i in order])
    steps = _steps(size)
    alphabets, counts, ranks = [], [], np.zeros((len(steps), len(blocks)), np.int16)
    for lane, i in enumerate(order):
        alphabet, ranks[: size[lane], lane], count = np.unique(blocks[i], return_inverse=True, return_counts=True)
        alphabets.append(alphabet)
        counts.append(count)
    model = _Model(counts, size, slots=False)
    low, span = np.zeros(len(blocks), np.int64), np.full(len(blocks), _WHOLE)
    words, used = np.zeros((len(blocks), 4 * len(steps) + 8), ">u2"), np.zeros(len(blocks), np.int64)
    for t, n in enumerate(steps.tolist()):
        model.predict(n)
        rank = ranks[t, :n].astype(np.int64)
        start, width = model.interval(rank)
        unit = _floor(span[:n], model.whole)
        low[:n] += unit * start
        span[:n] = unit * width
        for which, top in _settled(low[:n], span[:n]):
            words[which, used[which]] = top
            used[which] += 1
        model.learn(rank)
    every = np.arange(len(blocks))
    for _ in range(3):
        words[every, used] = low >> 32
        used += 1
        low = (low << 16) & _WHOLE
    done: list = [None] * len(blocks)
    for lane, i in enumerate(order):
        done[i] = (alphabets[lane], counts[lane], words[lane, : used[lane]].tobytes())
    return done


def _decode_lanes(blocks: list[tuple[np.ndarray, np.ndarray, bytes]]) -> list[np.ndarray]:
    sizes = [int(b[1].sum()) for b in blocks]
    order = sorted(range(len(blocks)), key=lambda i: -sizes[i])
    size = np.array([sizes[i] for i in order])
    steps = _steps(size)
    words = np.zeros((len(blocks), max((len(b[2]) // 2 for b in blocks), default=0) + 8), np.uint16)
    for lane, i in enumerate(order):
        raw = np.frombuffer(blocks[i][2], ">u2")
        words[lane, : len(raw)] = raw
    model = _Model([blocks[i][1] for i in order], size, slots=True)
    low, span, code = np.zeros(len(blocks), np.int64), np.full(len(blocks), _WHOLE), np.zeros(len(blocks), np.int64)
    for k in range(3):
        code = (code << 16) | words[:, k]
    used, end = np.full(len(blocks), 3), words.shape[1] - 1
    ranks = np.zeros((len(steps), len(blocks)), np.int16)
    for t, n in enumerate(steps.tolist()):
        model.predict(n)
        unit = _floor(span[:n], model.whole)
        value = np.minimum(_floor(code[:n] - low[:n], unit), model.whole - 1)
        rank, start, width = model.find(value)
        low[:n] += unit * start
        span[:n] = unit * width
        for which, _ in _settled(low[:n], span[:n]):
            code[which] = ((code[which] << 16) & _WHOLE) | words[which, np.minimum(used[which], end)]
            used[which] += 1
        ranks[t, :n] = rank
        model.learn(rank)
    done: list = [None] * len(blocks)
    for lane, i in enumerate(order):
        done[i] = blocks[i][0][ranks[: size[lane], lane]].astype(np.uint32)
    return done


def _varints(values: np.ndarray) -> bytes:
    """Seven bits a byte, the lowest first; values are below 2**35."""
    part = values.astype(np.int64)[:, None] >> np.arange(0, 35, 7)
    more = part > 127
    used = np.ones(part.shape, bool)
    used[:, 1:] = more[:, :-1]
    return ((part & 127) | (more << 7)).astype(np.uint8)[used].tobytes()


def _read_varints(raw: bytes, n: int) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    last = np.flatnonzero(data < 128)[:n]
    first = np.concatenate([[0], last[:-1] + 1]) if n else last
    place = np.arange(len(data)) - np.repeat(first, np.diff(np.concatenate([first, [len(data)]]))) if n else np.zeros(0, int)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), first) if n else np.zeros(0, np.int64)


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """One byte string for each block of ids: magic, sizes, alphabet with counts, code and checksum."""
    out = []
    for at in range(0, len(blocks), LANES):
        part = blocks[at : at + LANES]
        for ids, (alphabet, count, code) in zip(part, _encode_lanes(part), strict=True):
            head = _varints(np.concatenate([np.diff(alphabet.astype(np.int64), prepend=0), count]))
            body = MAGIC + struct.pack("<IIII", len(ids), len(alphabet), len(head), len(code)) + head + code
            out.append(body + struct.pack("<II", zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)))
    return out


def decode(raw: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; ValueError if a checksum doesn't hold."""
    out = []
    for at in range(0, len(raw), LANES):
        part = []
        for b in raw[at : at + LANES]:
            if b[:4] != MAGIC or zlib.crc32(b[:-8]) != struct.unpack("<I", b[-4:])[0]:
                raise ValueError("damaged block")
            n, kinds, head, code = struct.unpack("<IIII", b[4:20])
            listed = _read_varints(b[20 : 20 + head], 2 * kinds)
            if listed[kinds:].sum() != n:
                raise ValueError("damaged block")
            part.append((np.cumsum(listed[:kinds]), listed[kinds:], b[20 + head : 20 + head + code]))
        for b, ids in zip(raw[at : at + LANES], _decode_lanes(part), strict=True):
            if zlib.crc32(ids.astype("<u4").tobytes()) != struct.unpack("<I", b[-8:-4])[0]:
                raise ValueError("damaged block")
            out.append(ids)
    return out

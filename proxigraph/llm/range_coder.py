"""Blocks of token ids, range-coded under a mix of order-0 to order-2 predictions.

The ids of a call are numbered: those frequent enough for a share of the order-0 frequencies first, the
rare ones after them, which an escape and the bits of their number stand for. These ``Orders`` go with every block.
A block is BLOCK ids; all else of its model starts from nothing, so blocks decode on their own. All blocks
of a call go forward in lockstep, one id each at a step: a lane per block, numpy over the lanes.

Per lane: the id that last followed the id before (order 1) and the two ids before (order 2), each
with a confidence; and weights of the two predictions and of order 0 by the pair of confidences, moved
towards those that were right, where predictions that agree add up.
Everything is integer arithmetic. Ids are unsigned 32-bit integers.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK, LANES = 1024, 8192  # ids of a block, blocks that go forward together
SLOTS = 9  # bits of the tables that contexts are hashed to
WHOLE, LEAST, RATE = 1 << 16, 64, 4  # weights sum to WHOLE, order 0 has some LEAST, speed of weights
TOTAL = 16  # bits of the order-0 frequencies
_FULL, _LOW = (1 << 48) - 1, 1 << 32
_NONE = -4  # no id, no confidence


class Orders:
    """Order-0 frequencies: ``ids`` by number, of which the first ``common`` have one each and the rest share the
    last, the escape's."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.freq, self.common = ids, freq, len(freq) - 1
        self.start = np.cumsum(freq) - freq
        self.bits = max(0, len(ids) - self.common - 1).bit_length()

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[Orders, np.ndarray]:
        """The frequencies of ``ids``, and the number of each of them."""
        if int(ids.max()) < 1 << 20:
            every = np.bincount(ids)
            kinds = np.flatnonzero(every)
            count, place = every[kinds], np.cumsum(every > 0)[ids] - 1
        else:
            kinds, place, count = np.unique(ids, return_inverse=True, return_counts=True)
        share = (count << TOTAL) // len(ids)
        common = share > 1
        order = np.r_[np.flatnonzero(common), np.flatnonzero(~common)]
        freq = np.r_[share[common], 0]
        freq[-1] = max(1, int(count[~common].sum() << TOTAL) // len(ids))
        over = int(freq.sum()) - (1 << TOTAL)
        freq[int(freq.argmax())] -= over  # one too many at most, and the largest is 2 at least
        number = np.empty(len(kinds), np.int32)
        number[order] = np.arange(len(kinds), dtype=np.int32)
        return cls(kinds[order].astype(np.uint32), freq.astype(np.int64)), number[place]

    def pack(self) -> bytes:
        ids, k = self.ids.astype(np.int64), self.common
        parts = np.diff(ids[:k], prepend=0), self.freq, np.diff(ids[k:], prepend=0)
        return zlib.compress(b"".join([np.array([k, len(ids) - k], "<u4").tobytes(), *[p.astype("<u4").tobytes() for p in parts]]), 6)

    @classmethod
    def unpack(cls, data: bytes) -> Orders:
        flat = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)
        k, rare = int(flat[0]), int(flat[1])
        return cls(np.r_[np.cumsum(flat[2 : 2 + k]), np.cumsum(flat[3 + 2 * k : 3 + 2 * k + rare])].astype(np.uint32), flat[2 + k : 3 + 2 * k])


class Writer:
    """Range coders of several lanes: 48-bit low ends, words of 16 bits, carries settled at the end."""

    def __init__(self, lanes: int, words: int):
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, _FULL + 1)
        self.cap, self.words = words, np.zeros(lanes * words, np.uint32)
        self.at = np.arange(lanes) * words

    def put(self, n: int, low: np.ndarray, wide: np.ndarray) -> None:
        """The first ``n`` lanes go on with the ranges of ``wide`` from ``low``."""
        at = self.at[:n]
        over = (low > _FULL).nonzero()[0]
        if len(over):
            self.words[at[over] - 1] += 1
        self.words[at] = low >> 32 & 0xFFFF  # counts if the lane goes on
        small = wide < _LOW
        at += small
        shift = small.view(np.int8) << np.int8(4)
        self.low[:n], self.range[:n] = low << shift & _FULL, wide << shift
        rest = (self.range[:n] < _LOW).nonzero()[0]
        if len(rest):
            self.words[at[rest]] = self.low[rest] >> 32
            at[rest] += 1
            self.low[rest] = self.low[rest] << 16 & _FULL
            self.range[rest] <<= 16

    def some(self, lanes: np.ndarray, value: np.ndarray, bits: int) -> None:
        """Evenly distributed numbers of ``bits`` bits."""
        unit = self.range[lanes] >> bits
        low = self.low[lanes] + unit * value
        over = lanes[low > _FULL]
        self.words[self.at[over] - 1] += 1
        low &= _FULL
        small = unit < _LOW
        own = lanes[small]
        self.words[self.at[own]] = low[small] >> 32
        self.at[own] += 1
        low[small] = low[small] << 16 & _FULL
        unit[small] <<= 16
        self.low[lanes], self.range[lanes] = low, unit

    def room(self, more: int) -> None:
        """Make sure that each lane can take ``more`` words."""
        lanes = len(self.at)
        first = np.arange(lanes) * self.cap
        if lanes and int((self.at - first).max()) + more > self.cap:
            cap = 2 * self.cap + more
            words = np.zeros((lanes, cap), np.uint32)
            words[:, : self.cap] = self.words.reshape(-1, self.cap)
            self.at += np.arange(lanes) * (cap - self.cap)
            self.cap, self.words = cap, words.reshape(-1)

    def close(self) -> list[np.ndarray]:
        """The words of each lane."""
        self.room(1)
        self.words[self.at] = self.low + _LOW - 1 >> 32  # a number within the range whose lower words are zero
        size = self.at - np.arange(len(self.at)) * self.cap + 1
        while len(over := (self.words >> 16).nonzero()[0]):
            self.words[over] -= 1 << 16
            np.add.at(self.words, over - 1, 1)
        words = self.words.astype("<u2").reshape(-1, self.cap)
        return [w[:n] for w, n in zip(words, size.tolist(), strict=True)]


class Reader:
    def __init__(self, words: list[np.ndarray]):
        size = np.array([len(w) for w in words])
        self.words = np.concatenate([np.concatenate([w, np.zeros(3, "<u2")]) for w in words]).astype(np.int64)
        self.at = np.cumsum(size + 3) - size - 3
        self.code = (self.words[self.at] << 32) | (self.words[self.at + 1] << 16) | self.words[self.at + 2]
        self.at += 3
        self.range = np.full(len(words), _FULL + 1)

    def take(self, n: int, code: np.ndarray, wide: np.ndarray) -> None:
        """The first ``n`` lanes go on with the ranges of ``wide``, ``code`` from their low ends."""
        at = self.at[:n]
        small = wide < _LOW
        shift = small.view(np.int8) << np.int8(4)
        self.code[:n], self.range[:n] = code << shift | self.words.take(at) * small, wide << shift
        at += small
        rest = (self.range[:n] < _LOW).nonzero()[0]
        if len(rest):
            self._more(rest)

    def _more(self, lanes: np.ndarray) -> None:
        self.code[lanes] = self.code[lanes] << 16 | self.words[self.at[lanes]]
        self.at[lanes] += 1
        self.range[lanes] <<= 16

    def some(self, lanes: np.ndarray, bits: int) -> np.ndarray:
        unit = self.range[lanes] >> bits
        value = quotient(self.code[lanes], unit, bits)
        self.code[lanes] -= unit * value
        self.range[lanes] = unit
        self._more(lanes[unit < _LOW])
        return value


def quotient(code: np.ndarray, unit: np.ndarray, bits: int) -> np.ndarray:
    """Below 2^bits, 16 at most, from parts below 2^48, so doubles give its floor."""
    return np.minimum((code / unit).astype(np.int64), (1 << bits) - 1)


class _Model:
    """Predictions of all lanes before an id, and what the id teaches them: order 1 in the first rows, order 2
    in the second. Tables hold number * 4 + confidence, weights two 16-bit halves."""

    def __init__(self, lanes: int):
        self.table = np.full(2 * lanes << SLOTS, _NONE, np.int32)
        prior = np.array([0, WHOLE // 4, WHOLE // 2, WHOLE * 3 // 4])
        a, b = np.repeat(prior, 4), np.tile(prior, 4)
        self.weights = np.tile(((a - a * b // (2 * WHOLE)) << 16 | (WHOLE - a) * b // WHOLE).astype(np.uint32), lanes)
        self.row, self.state = (np.arange(2 * lanes) << SLOTS).reshape(2, lanes), np.arange(lanes) << 4
        self.second, self.mix = np.zeros(lanes, np.uint32), np.empty((2, lanes), np.uint32)

    def look(self, n: int, x1: np.ndarray) -> None:
        """Predictions after ``x1`` and the id of the call before."""
        mix = self.mix[:, :n]
        np.multiply(x1.view(np.uint32), np.uint32(0x9E3779B1), out=mix[0])
        np.multiply(mix[0] ^ self.second[:n], np.uint32(0xC2B2AE3D), out=mix[1])
        self.second = mix[0] >> np.uint32(7)
        self.k = self.row[:, :n] + (mix >> np.uint32(32 - SLOTS))
        self.e = self.table.take(self.k)
        self.c, self.i = self.e & 3, self.e >> 2
        self.s = self.state[:n] + (self.c[1] << 2 | self.c[0])
        w = self.weights.take(self.s)
        self.v = np.empty((2, n), np.int32)
        np.bitwise_and(w, np.uint32(0xFFFF), out=self.v[0].view(np.uint32))
        np.right_shift(w, np.uint32(16), out=self.v[1].view(np.uint32))
        self.both = self.v[0] + self.v[1]

    def learn(self, x: np.ndarray, right: np.ndarray) -> None:
        """``right``: which of the two foretold ``x``."""
        self.table[self.k] = np.where(right, self.e + (self.c < 3), np.where(self.c > 1, self.e - 1, x << 2 | 1))
        won = np.right_shift(np.int32(WHOLE - LEAST), right[0] & right[1], dtype=np.int32)  # shared where both are right
        v = self.v + (np.where(right, won, np.int32((1 << RATE) - 1)) - self.v >> RATE)  # those of predictions never reach 0
        self.weights[self.s] = (v[1] << 16 | v[0]).view(np.uint32)


def _digits(bits: int) -> list[tuple[int, int]]:
    """Widths of the parts of a rare id's number, and where they lie in it."""
    return [(min(16, bits - at), at) for at in range(0, bits, 16)]


def encode(ids: np.ndarray) -> list[tuple[int, Orders, bytes]]:
    """(ids, order 0, payload) of each block of ``ids``."""
    if not len(ids):
        return []
    orders, numbers = Orders.of(ids)
    out = []
    for i in range(0, len(ids), BLOCK * LANES):
        out += _encode(numbers[i : i + BLOCK * LANES], orders)
    return out


def _encode(numbers: np.ndarray, orders: Orders) -> list[tuple[int, Orders, bytes]]:
    lanes = -(-len(numbers) // BLOCK)
    size = np.full(lanes, BLOCK)
    size[-1] = len(numbers) - BLOCK * (lanes - 1)
    grid = np.zeros(lanes * BLOCK, np.int32)
    grid[: len(numbers)] = numbers
    grid = np.ascontiguousarray(grid.reshape(lanes, BLOCK)[:, : size.max()].T)
    out, model, rare = Writer(lanes, len(grid) + 256), _Model(lanes), len(orders.ids) > orders.common
    x1 = np.zeros(lanes, np.int32)
    for t in range(len(grid)):
        n = lanes if t < size[-1] else lanes - 1
        x = grid[t, :n]
        if t % 64 == 0:
            out.room(320)  # at most five words an id
        known = np.minimum(x, orders.common) if rare else x
        model.look(n, x1[:n])
        right = model.i == x
        is1, is2 = right
        hit = is1 | is2
        unit = out.range[:n] >> 16
        both = unit * model.both
        share = unit * np.where(is2, np.where(is1, model.both, model.v[1]), model.v[0])
        sub = (unit << 16) - both >> TOTAL
        low = np.where(hit, unit * np.where(is2, 0, model.v[1]), both + sub * orders.start.take(known))
        out.put(n, out.low[:n] + low, np.where(hit, share, sub * orders.freq.take(known)))
        if rare and len(own := (~hit & (x >= orders.common)).nonzero()[0]):
            for bits, at in _digits(orders.bits):
                out.some(own, x[own] - orders.common >> at & (1 << bits) - 1, bits)
        model.learn(x, right)
        x1 = x
    return [(int(n), orders, w.tobytes()) for n, w in zip(size, out.close(), strict=True)]


def decode(blocks: list[tuple[int, Orders, bytes]]) -> np.ndarray:
    """The ids of blocks, one after the other, as unsigned 32-bit integers."""
    out, i = [], 0
    while i < len(blocks):
        z = next((k for k in range(i, min(i + LANES, len(blocks))) if blocks[k][1] is not blocks[i][1]), min(i + LANES, len(blocks)))
        some = blocks[i:z]
        order = sorted(range(len(some)), key=lambda k: -some[k][0])  # lanes that go on longest come first
        back = dict(zip(order, _decode([some[k] for k in order], some[0][1]), strict=True))
        out += [back[k] for k in range(len(some))]
        i = z
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _decode(blocks: list[tuple[int, Orders, bytes]], orders: Orders) -> list[np.ndarray]:
    lanes, size = len(blocks), np.array([b[0] for b in blocks])
    src, model, rare = Reader([np.frombuffer(b[2], "<u2") for b in blocks]), _Model(lanes), len(orders.ids) > orders.common
    slots = np.repeat(np.arange(len(orders.freq), dtype=np.int32), orders.freq)
    grid = np.zeros((int(size[0]), lanes), np.int32)
    x1 = np.zeros(lanes, np.int32)
    for t in range(len(grid)):
        n = lanes if t < size[-1] else int(np.searchsorted(-size, -t))
        model.look(n, x1[:n])
        code, unit = src.code[:n], src.range[:n] >> 16
        both = unit * model.both
        near = code < both
        v2 = unit * model.v[1]
        sub = (unit << 16) - both >> TOTAL
        x = slots.take(quotient(np.maximum(code - both, 0), sub, TOTAL))
        agree = model.i[0] == model.i[1]
        is2 = near & (agree | (code < v2))
        is1 = near & (agree | ~is2)
        low = np.where(near, np.where(is2, 0, v2), both + sub * orders.start.take(x))
        wide = np.where(near, unit * np.where(is2, np.where(is1, model.both, model.v[1]), model.v[0]), sub * orders.freq.take(x))
        src.take(n, code - low, wide)
        x = np.where(near, np.where(is2, model.i[1], model.i[0]), x)
        if rare and len(own := (~near & (x == orders.common)).nonzero()[0]):
            for bits, at in _digits(orders.bits):
                x[own] += (src.some(own, bits) << at).astype(np.int32)
        model.learn(x, np.stack([is1, is2]))
        grid[t, :n] = x
        x1 = x
    rows = orders.ids[grid.T]
    return [r[:n] for r, n in zip(rows, size.tolist(), strict=True)]

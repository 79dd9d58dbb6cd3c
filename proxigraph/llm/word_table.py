"""Words of many texts at once by the byte-level pattern, and a table that keeps the ids of words.

Texts hold only characters whose class is beyond doubt (see ``token_ids``), so every byte from 0x80 on
belongs to a letter and a word's bytes hold no zero: zeros fill up the two numbers that a word of up to 16 bytes is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

SLOTS = 21  # bits of the table's places
KEPT = 5 << SLOTS - 3  # words that it holds at most
SHORT = 16  # bytes of the words that it holds
_LETTER, _DIGIT, _MARK, _BLANK = range(4)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[48:58], _CLASS[[9, 10, 13, 32]] = _DIGIT, _BLANK
_MASK = np.array([(1 << 8 * min(8, k)) - 1 for k in range(SHORT + 1)], np.uint64)  # of the first 8 bytes, by length
_REST = np.array([(1 << 8 * max(0, k - 8)) - 1 for k in range(SHORT + 1)], np.uint64)


def starts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the words of ``data`` start; its texts start at ``first``."""
    n, kind = len(data), _CLASS[data]
    start, new = np.zeros(n + 4, bool), np.zeros(n + 4, bool)
    new[first] = True
    start[1:n] = kind[1:] != kind[:-1]
    start |= new
    last = np.flatnonzero((kind[:-1] == _BLANK) & start[1:n] & ~new[1:n])  # of blanks before a word of the same text
    start[last] = True
    start[last[data[last] == 32] + 1] = False  # a blank goes with the word
    quote = np.flatnonzero(data == 39)
    quote = quote[start[quote] & start[quote + 1] & ~new[quote + 1] & (quote + 1 < n)]
    a, b = data[quote + 1], np.where((quote + 2 < n) & ~new[quote + 2], data[np.minimum(quote + 2, n - 1)], 0)
    one = np.isin(a, list(b"stmd"))
    two = (np.isin(a, list(b"rv")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    start[quote[one | two] + 1] = False
    start[quote[one] + 2] = True
    start[quote[two] + 3] = True
    return np.flatnonzero(start[:n])


class WordTable:
    """``model`` gives the ids of words, and the number of each, from their bytes. Short words are remembered; when the table is full, those not
    met since it last was are forgotten, or all if they are too few."""

    def __init__(self, model: Callable[[list[bytes]], tuple[list[int], list[int]]], end: int):
        self.model, self.end = model, end
        self.clear()

    def clear(self) -> None:
        self.a, self.b = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.uint64)
        self.value, self.met = np.zeros(1 << SLOTS, np.int64), np.zeros(1 << SLOTS, bool)
        self.pool, self.used, self.words = np.full(1 << 16, self.end, np.uint32), 1, 0

    def _place(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a ^ b * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).view(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words are, or would be, and which of them are not in the table."""
        at = self._place(a, b)
        left = np.flatnonzero((self.a[at] != a) | (self.b[at] != b))
        new = []
        while len(left):
            own = at[left]
            empty = self.a[own] == 0
            new.append(left[empty])
            left = left[~empty]
            at[left] = own[~empty] + 1 & (1 << SLOTS) - 1
            left = left[(self.a[at[left]] != a[left]) | (self.b[at[left]] != b[left])]
        return at, np.concatenate(new) if new else left

    def _insert(self, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> None:
        """Different words that are not in the table."""
        at, left = self._place(a, b), np.arange(len(a))
        while len(left):
            own = at[left]
            free = self.a[own] == 0
            won, own = left[free], own[free]
            self.b[own] = won  # one of those that want the place
            won = won[self.b[own] == won.astype(np.uint64)]
            own = at[won]
            self.a[own], self.b[own], self.value[own], self.met[own] = a[won], b[won], value[won], True
            left = left[~np.isin(left, won)]
            at[left] = at[left] + 1 & (1 << SLOTS) - 1
        self.words += len(a)

    def _add(self, words: list[bytes]) -> np.ndarray:
        """Put the ids of words into the pool; the place and number of each word's."""
        flat, size = self.model(words)
        size = np.array(size, np.int64)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) + len(flat), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return self.used - len(flat) + np.cumsum(size) - size << 32 | size

    def _forget(self) -> None:
        old = np.flatnonzero(self.met & (self.a != 0))
        if len(old) > KEPT // 2:
            old = old[:0]
        a, b, value, pool = self.a[old], self.b[old], self.value[old], self.pool
        self.clear()
        size, at = value & 0xFFFFFFFF, value >> 32
        ends = np.cumsum(size)
        self.used = 1 + int(size.sum())
        self.pool = np.full(max(1 << 16, 2 * self.used), self.end, np.uint32)
        self.pool[1 : self.used] = pool[np.repeat(at - ends + size, size) + np.arange(self.used - 1)]
        self._insert(a, b, ends - size + 1 << 32 | size)
        self.met[:] = False

    def ids(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of texts that lie in ``data`` one after the other, ``size`` bytes each;
        an end id follows each text."""
        stop, padded = np.cumsum(size), np.concatenate([data, np.zeros(SHORT + 8, np.uint8)])
        at = starts(data, (stop - size)[size > 0]) if len(data) else np.zeros(0, np.int64)
        length, ends, out, counts = np.diff(at, append=len(data)), np.searchsorted(at, stop), [], []
        for i in range(0, max(1, len(at)), KEPT // 2):
            z = min(i + KEPT // 2, len(at))
            value = self._values(padded, at[i:z], length[i:z])
            own = ends[(ends >= i) & ((ends < z) | (z == len(at)))] - i
            value = np.insert(value, own, 1)  # the end id lies first in the pool
            count = value & 0xFFFFFFFF
            total = np.cumsum(count)
            out.append(self.pool[np.repeat((value >> 32) - total + count, count) + np.arange(total[-1] if len(total) else 0)])
            counts.append(count)
        total = np.cumsum(np.concatenate(counts))
        return np.concatenate(out), np.diff(total[ends + np.arange(len(ends))], prepend=0)

    def _values(self, padded: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Where the ids of words are in the pool, and how many: of KEPT // 2 words at most, until the next call."""
        wide = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        short = length <= SHORT
        own, size = (at, length) if short.all() else (at[short], length[short])
        a, b = wide[own] & _MASK[size], wide[own + 8] & _REST[size]
        place, new = self._find(a, b)
        if len(new):
            words, raw = {}, padded.tobytes()
            for k, p, z in zip(new.tolist(), own[new].tolist(), (own + size)[new].tolist(), strict=True):
                words.setdefault(raw[p:z], k)
            if self.words + len(words) > KEPT:
                self._forget()
                return self._values(padded, at, length)
            first = np.fromiter(words.values(), np.int64, len(words))
            self._insert(a[first], b[first], self._add([*words]))
            place, _ = self._find(a, b)
        self.met[place] = True
        if len(own) == len(at):
            return self.value[place]
        value, used = np.empty(len(at), np.int64), self.used
        value[short], rest = self.value[place], np.flatnonzero(~short)
        value[rest] = self._add([padded[p:z].tobytes() for p, z in zip(at[rest].tolist(), (at + length)[rest].tolist(), strict=True)])
        self.used = used  # long words are not remembered
        return value

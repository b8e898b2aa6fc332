"""Elias-Fano coding of monotone sequences, and a two-level n-gram trie on it.

All arrays are views of one buffer, so a level can be memory-mapped.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

#: Pairs looked up at a time.
PIECE = 1 << 16
#: Lowest and highest bit of each byte, the lower half of each half byte.
_LOWEST, _HIGHEST, _PAIRS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080), np.uint64(0x3333333333333333)
_ALL = 0xFFFFFFFFFFFFFFFF
#: Place of the r-th one bit of each byte.
_IN_BYTE = np.zeros((256, 8), dtype=np.uint8)
for _byte in range(256):
    for _rank, _place in enumerate(p for p in range(8) if _byte >> p & 1):
        _IN_BYTE[_byte, _rank] = _place


def mapped(data: bytes) -> memoryview:
    """The bytes as a memory-mapped file that goes with its last view."""
    with tempfile.TemporaryFile() as file:
        file.write(data or b"\0")
        file.flush()
        return memoryview(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of ``bits`` bits each, packed into 64-bit words (and a spare one)."""
    out = np.zeros(len(values) * bits // 64 + 2, dtype=np.uint64)
    if bits and len(values):
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(bits)
        word, place = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        # A value begins in every word up to the last one.
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[: len(first)] = np.bitwise_or.reduceat(values << place, first)
        # At most one value reaches from a word into the next.
        over = np.flatnonzero(place + np.uint64(bits) > np.uint64(64))
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - place[over])
    return out


class EliasFano:
    """A non-decreasing sequence of integers with random access and successor search."""

    def __init__(self, buffer, offset: int = 0) -> None:
        self.n, self.bits, low_words, high_words = (int(x) for x in np.frombuffer(buffer, np.int64, 4, offset))
        offset += 32
        self.low = np.frombuffer(buffer, np.uint64, low_words, offset)
        offset += 8 * low_words
        self.high = np.frombuffer(buffer, np.uint64, high_words, offset)
        offset += 8 * high_words
        #: Ones before each word.
        self.ones = np.frombuffer(buffer, np.int64, high_words + 1, offset)
        self.end = offset + 8 * (high_words + 1)
        self.zeros = np.arange(high_words + 1, dtype=np.int64) * 64 - self.ones

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = _pack(values & np.uint64((1 << bits) - 1), bits)
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        marks = np.zeros(((top >> bits) // 64 + n // 64 + 3) * 64, dtype=bool)
        marks[places] = True
        high = np.packbits(marks, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]).astype(np.int64)
        head = np.array([n, bits, len(low), len(high)], dtype=np.int64)
        return b"".join(x.tobytes() for x in (head, low, high, ones))

    def _select(self, rank: np.ndarray, before: np.ndarray, flip: int) -> np.ndarray:
        """Places of the bits of the given ranks (ones, or zeros if flipped)."""
        word = np.searchsorted(before, rank, side="right") - 1
        rest = (rank - before[word]).astype(np.uint64)
        bits = self.high[word] ^ np.uint64(flip)
        # Ones of each byte, then of all bytes up to it.
        sums = bits - ((bits >> np.uint64(1)) & np.uint64(0x5555555555555555))
        sums = (sums & _PAIRS) + ((sums >> np.uint64(2)) & _PAIRS)
        sums = ((sums + (sums >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _LOWEST
        # The bit lies behind the bytes whose sums do not reach beyond its rank.
        shift = np.bitwise_count(((rest * _LOWEST | _HIGHEST) - sums) & _HIGHEST).astype(np.uint64) << np.uint64(3)
        rest -= ((sums << np.uint64(8)) >> shift) & np.uint64(255)
        return word * 64 + shift.astype(np.int64) + _IN_BYTE[(bits >> shift) & np.uint64(255), rest]

    def _low(self, index: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(index), dtype=np.uint64)
        at = index.astype(np.uint64) * np.uint64(self.bits)
        word, place = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        value = self.low[word] >> place
        over = place + np.uint64(self.bits) > np.uint64(64)
        value[over] |= self.low[word[over] + 1] << (np.uint64(64) - place[over])
        return value & np.uint64((1 << self.bits) - 1)

    def access(self, index: np.ndarray) -> np.ndarray:
        """Values at the given places."""
        index = np.asarray(index, dtype=np.int64)
        high = (self._select(index, self.ones, 0) - index).astype(np.uint64)
        return (high << np.uint64(self.bits)) | self._low(index)

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first element >= each value (n if none), and whether it is equal."""
        values = np.asarray(values, dtype=np.uint64)
        if not self.n:
            return np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=bool)
        high = (values >> np.uint64(self.bits)).astype(np.int64)
        wanted = values & np.uint64((1 << self.bits) - 1)
        zeros = int(self.zeros[-1])
        inside = high < zeros
        place = np.full(len(values), self.n, dtype=np.int64)
        stop = place.copy()
        some = np.flatnonzero(inside)
        h = high[some]
        # Elements with a high part below h end in front of the h-th zero.
        place[some] = np.where(h > 0, self._select(np.maximum(h - 1, 0), self.zeros, _ALL) - (h - 1), 0)
        stop[some] = self._select(h, self.zeros, _ALL) - h
        low, end = place.copy(), stop.copy()
        while len(open_rows := np.flatnonzero(low < end)):
            middle = (low[open_rows] + end[open_rows]) >> 1
            less = self._low(middle) < wanted[open_rows]
            low[open_rows] = np.where(less, middle + 1, low[open_rows])
            end[open_rows] = np.where(less, end[open_rows], middle)
        equal = low < stop
        at = np.flatnonzero(equal)
        equal[at] = self._low(low[at]) == wanted[at]
        return low, equal


class Trie:
    """Contexts, pointers and successors with a quantised value each.

    Level 1 holds the contexts, level 2 their successors. A successor is stored
    relative to its context: its id behind the ids of all contexts before it.
    ``spread`` is the least power of two above every id, so low bits are as few as the ids need.
    """

    def __init__(self, buffer) -> None:
        self.spread = int(np.frombuffer(buffer, np.int64, 1)[0])
        self.contexts = EliasFano(buffer, 8)
        self.pointers = EliasFano(buffer, self.contexts.end)
        self.successors = EliasFano(buffer, self.pointers.end)
        self.values = np.frombuffer(buffer, np.uint16, self.successors.n, self.successors.end)

    @staticmethod
    def encode(context: np.ndarray, successor: np.ndarray, values: np.ndarray) -> bytes:
        """Pairs must be distinct and sorted by context, then successor."""
        spread = 1 << int(successor.max(initial=0)).bit_length()
        names, first = np.unique(context, return_index=True)
        number = np.repeat(np.arange(len(names)), np.diff(np.append(first, len(context))))
        relative = number.astype(np.uint64) * np.uint64(spread) + successor.astype(np.uint64)
        return b"".join(
            (
                np.array([spread], dtype=np.int64).tobytes(),
                EliasFano.encode(names),
                EliasFano.encode(np.append(first, len(context))),
                EliasFano.encode(relative),
                np.asarray(values, dtype=np.uint16).tobytes(),
            )
        )

    def find(self, context: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Value of each pair (0 if absent), whether it is there, and its place among all pairs.

        Quickest for sorted pairs. They are looked up in pieces, so what that takes stays small.
        """
        cuts = range(0, max(1, len(context)), PIECE)
        parts = [self._find(context[i : i + PIECE], successor[i : i + PIECE]) for i in cuts]
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    def _find(self, context: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # Equal contexts that lie together are looked up once.
        fresh = np.flatnonzero(np.concatenate([np.ones(min(1, len(context)), dtype=bool), context[1:] != context[:-1]]))
        number, known = self.contexts.successor(context[fresh])
        first, last = np.zeros_like(number), np.zeros_like(number)
        first[known] = self.pointers.access(number[known])
        last[known] = self.pointers.access(number[known] + 1)
        runs = np.diff(np.append(fresh, len(context)))
        number, known, first, last = (np.repeat(x, runs) for x in (number, known, first, last))
        found = known & (successor < np.uint64(self.spread))
        value = np.zeros(len(found), dtype=np.uint16)
        places = np.zeros(len(found), dtype=np.int64)
        some = np.flatnonzero(found)
        relative = number[some].astype(np.uint64) * np.uint64(self.spread) + successor[some].astype(np.uint64)
        place, equal = self.successors.successor(relative)
        # The place must be inside the context's range.
        equal &= (place >= first[some]) & (place < last[some])
        found[some] = equal
        value[some[equal]] = self.values[place[equal]]
        places[some[equal]] = place[equal]
        return value, found, places

"""N-grams of whole columns in an open-addressed table of arrays.

The words of a chunk lie in one buffer with single spaces between them, so an n-gram is a span of it. Its key is the
xxhash64 of the span. Spans are interned by linear probing, all of them at once: whoever finds its slot free takes it, and a
span belongs to a slot only if key, length and bytes equal those of the slot's owner. Slots then hold one bucket (the CRC-32
of the owner) and one count each, and every occurrence knows its slot.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import xxhash

from .kernels import U, runs

#: A to Z as a to z; digits, a to z and all bytes of other scripts make words
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = IN_WORD[128:] = True
CHUNK_WORDS = 1 << 15
CHUNK_BYTES = 1 << 20
#: longer spans are few for their bytes and are hashed and compared one by one
LONG = 256

# fixed values: the primes of xxhash64 and the polynomial of CRC-32
P1, P2, P3, P4, P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
POLYNOMIAL = np.uint32(0xEDB88320)


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & np.uint32(1), (c >> np.uint32(1)) ^ POLYNOMIAL, c >> np.uint32(1))
    return c


CRC = _crc_table()
LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], U)


def _rotated(x: np.ndarray, k: int) -> np.ndarray:
    return (x << U(k)) | (x >> U(64 - k))


class Spans:
    """Spans [start, start + length) of one buffer."""

    def __init__(self, buffer: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
        self.eights = np.ndarray((len(buffer) + 1,), "<u8", self.padded.data, 0, (1,))  # eight bytes from every place
        self.start, self.length = start, length

    def raw(self, i: int) -> bytes:
        return self.padded[self.start[i] : self.start[i] + self.length[i]].tobytes()

    def _by_length(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`which` without long spans, the longest first, and the long ones."""
        n = self.length[which]
        short = which[n <= LONG]
        return short[np.argsort(-self.length[short].astype(np.int16), kind="stable")], which[n > LONG]

    def xxhash64(self) -> np.ndarray:
        out = np.empty(len(self.start), U)
        order, long = self._by_length(np.arange(len(self.start)))
        at, n = self.start[order], self.length[order]
        fewer = lambda size: int(np.searchsorted(-n, -size, "right"))  # noqa: E731  (how many have at least `size` bytes)
        h = np.full(len(order), P5, U)
        done = np.zeros(len(order), np.int64)
        if k := fewer(32):
            lanes = [np.full(k, U((int(P1) + int(P2)) % 2**64), U), np.full(k, P2, U), np.zeros(k, U), np.full(k, U(2**64 - int(P1)), U)]
            while m := fewer(int(done[0]) + 32):
                for j, lane in enumerate(lanes):
                    lane[:m] = _rotated(lane[:m] + self.eights[at[:m] + done[:m] + 8 * j] * P2, 31) * P1
                done[:m] += 32
            mixed = _rotated(lanes[0], 1) + _rotated(lanes[1], 7) + _rotated(lanes[2], 12) + _rotated(lanes[3], 18)
            for lane in lanes:
                mixed = (mixed ^ (_rotated(lane * P2, 31) * P1)) * P1 + P4
            h[:k] = mixed
        h += n.astype(U)
        left = n - done
        while len(some := np.flatnonzero(left >= 8)):
            v = self.eights[at[some] + done[some]]
            h[some] = _rotated(h[some] ^ (_rotated(v * P2, 31) * P1), 27) * P1 + P4
            done[some] += 8
            left[some] -= 8
        some = np.flatnonzero(left >= 4)
        h[some] = _rotated(h[some] ^ ((self.eights[at[some] + done[some]] & LOW_BYTES[4]) * P1), 23) * P2 + P3
        done[some] += 4
        left[some] -= 4
        while len(some := np.flatnonzero(left > 0)):
            h[some] = _rotated(h[some] ^ (self.padded[at[some] + done[some]].astype(U) * P5), 11) * P1
            done[some] += 1
            left[some] -= 1
        for shift, prime in ((33, P2), (29, P3)):
            h ^= h >> U(shift)
            h *= prime
        out[order] = h ^ (h >> U(32))
        for i in long.tolist():
            out[i] = xxhash.xxh64_intdigest(self.raw(i))
        return out

    def crc32(self, which: np.ndarray) -> np.ndarray:
        """CRC-32 of some spans."""
        order, long = self._by_length(which)
        at, n = self.start[order], self.length[order]
        c = np.full(len(order), 0xFFFFFFFF, np.uint32)
        for j in range(int(n[0]) if len(n) else 0):
            m = int(np.searchsorted(-n, -(j + 1), "right"))
            c[:m] = CRC[(c[:m] ^ self.padded[at[:m] + j]) & np.uint32(255)] ^ (c[:m] >> np.uint32(8))
        out = np.empty(len(self.start), np.uint32)
        out[order] = ~c
        for i in long.tolist():
            out[i] = zlib.crc32(self.raw(i))
        return out[which]

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pairs of spans of the same length have the same bytes."""
        out = np.ones(len(a), bool)
        left = self.length[a]
        some = np.flatnonzero(left <= LONG)
        j = 0
        while len(some):
            differ = (self.eights[self.start[a[some]] + j] ^ self.eights[self.start[b[some]] + j]) & LOW_BYTES[np.minimum(left[some] - j, 8)]
            out[some[differ != 0]] = False
            j += 8
            some = some[(differ == 0) & (left[some] > j)]
        for i in np.flatnonzero(left > LONG).tolist():
            out[i] = self.raw(a[i]) == self.raw(b[i])
        return out


class Table:
    """The spans of a chunk, interned: for each used slot its owner, bucket and count, and for each span its used slot."""

    def __init__(self, spans: Spans, n_buckets: int):
        n = len(spans.start)
        keys = spans.xxhash64()
        size = 1 << max(4, int(2 * n - 1).bit_length())
        owner = np.full(size, -1, np.int64)
        slot = (keys & U(size - 1)).astype(np.int64)
        settled = np.empty(n, np.int64)
        pending = np.arange(n)
        while len(pending):
            at = slot[pending]
            free = owner[at] < 0
            owner[at[free]] = pending[free]
            held = owner[at]
            mine = (keys[held] == keys[pending]) & (spans.length[held] == spans.length[pending])
            some = np.flatnonzero(mine & (held != pending))
            mine[some] = spans.equal(held[some], pending[some])
            settled[pending[mine]] = at[mine]
            pending = pending[~mine]
            slot[pending] = (slot[pending] + 1) & (size - 1)
        used = np.flatnonzero(owner >= 0)
        rank = np.empty(size, np.int64)
        rank[used] = np.arange(len(used))
        self.owner = owner[used]
        self.slot = rank[settled]
        self.count = np.bincount(self.slot, minlength=len(used))
        self.bucket = (spans.crc32(self.owner) % np.uint32(n_buckets)).astype(np.int64)


def tables(data: np.ndarray, at: np.ndarray, n_buckets: int, longest: int = 3) -> tuple[np.ndarray, Iterator[tuple[Table, np.ndarray]]]:
    """Words of each row; and for each chunk of words the table of the n-grams that begin in it, with the row of each."""
    starts, ends, rows = runs(IN_WORD[data], at)
    row_of_word = np.repeat(np.arange(len(at) - 1), np.diff(rows))

    def chunks() -> Iterator[tuple[Table, np.ndarray]]:
        lo, n = 0, len(starts)
        while lo < n:
            hi = min(lo + CHUNK_WORDS, max(lo + 1, int(np.searchsorted(ends, starts[lo] + CHUNK_BYTES))), n)
            stop = min(hi + longest - 1, n)
            size = ends[lo:stop] - starts[lo:stop]
            place = np.cumsum(size + 1) - (size + 1)
            buffer = np.full(int(place[-1] + size[-1]), 32, np.uint8)
            inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            buffer[np.repeat(place, size) + inside] = LOWER[data[np.repeat(starts[lo:stop], size) + inside]]
            row = row_of_word[lo:stop]
            found = []
            for k in range(longest):
                first = np.arange(max(min(hi - lo, stop - lo - k), 0))
                first = first[row[first] == row[first + k]]
                found.append((place[first], place[first + k] + size[first + k] - place[first], row[first]))
            start, length, of_row = (np.concatenate(x) for x in zip(*found, strict=True))
            yield Table(Spans(buffer, start, length), n_buckets), of_row
            lo = hi

    return np.diff(rows), chunks()

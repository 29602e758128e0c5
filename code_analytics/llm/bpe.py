"""Byte-level BPE ids of whole columns: words are found with array operations, each distinct word is encoded once.

The word pattern is that of the tokenizer file (contractions, then letters, numbers or other signs with at most one
space before them, then white space). Texts with code points that this Python's Unicode tables don't know, and texts with
the string of a special token of the file, are given to the tokenizer whole, as the file has it.
"""

from __future__ import annotations

import json
import os
import sys
import unicodedata

import numpy as np

from .kernels import U, mix, runs, span_codes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

OTHER, LETTER, NUMBER, BLANK, UNKNOWN = range(5)
CACHED_WORDS = 400_000
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _classes:
        by = {"L": LETTER, "N": NUMBER}
        table = np.full(sys.maxunicode + 1, UNKNOWN, np.uint8)
        named = range(0x33500)  # planes 0 to 3; later ones hold next to nothing
        table[: len(named)] = [by.get(k[0], UNKNOWN if k == "Cn" else OTHER) for k in map(unicodedata.category, map(chr, named))]
        table[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
        table[0] = UNKNOWN
        _classes.append(table)
    return _classes[0]


def word_starts(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the pattern's matches begin, in the code points of rows with offsets `at`; the matches have no gaps."""
    n = len(points)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[at] = True
    changed = np.ones(n, bool)
    changed[1:] = kind[1:] != kind[:-1]
    start = changed | first[:-1]
    space = points == 32
    # a run takes the one space before it
    joins = np.flatnonzero(start[1:] & ~first[1:-1] & space[:-1] & (kind[1:] != BLANK)) + 1
    start[joins] = False
    # white space before a word leaves its last character as a match of its own, or to the word
    _, ends, _ = runs(kind == BLANK, at)
    ends = ends[~first[ends]]
    start[ends - 1] = True
    # contractions: an apostrophe that begins a match, then letters
    quote = np.flatnonzero((points == 39) & start)
    quote = quote[quote + 1 < n]
    if len(quote):
        follow = lambda k: np.where((quote + k < n) & (np.searchsorted(at, quote + k, "right") == np.searchsorted(at, quote, "right")), points[np.minimum(quote + k, n - 1)], 0)
        one, two = follow(1), follow(2)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.isin(one, [ord("r"), ord("v")]) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for hits, k in ((quote[short], 2), (quote[long & ~short], 3)):
            start[hits + 1] = False
            stops = hits + k
            start[stops[stops < n]] = True
    return np.flatnonzero(start)


def byte_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a byte-level BPE file: the bytes of each token and its id, which is also its merge rank."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    # bytes without a visible sign of their own are written as the code points from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    sign = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    return {bytes(map(sign.__getitem__, token)): k for token, k in vocab.items() if all(c in sign for c in token)}


def _rows_with(raw: bytes, literal: bytes, at: np.ndarray) -> set[int]:
    """Rows of the bytes `raw`, cut at the offsets `at`, that hold `literal`."""
    found, place = set(), raw.find(literal)
    while place >= 0:
        row = int(np.searchsorted(at, place, "right")) - 1
        if place + len(literal) <= at[row + 1]:
            found.add(row)
        place = raw.find(literal, place + 1)
    return found


class Encoder:
    """Ids of many texts at once; keeps the ids of the words it has met, up to CACHED_WORDS.

    Words are merged by tiktoken from the vocabulary of the tokenizer file, one NUL between them; whole odd texts
    go to the tokenizers library. Both give the ids of the file.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        ranks = byte_ranks(path)
        ranks = {k: v for k, v in ranks.items() if not (k.startswith(b"<|") and k.endswith(b"|>"))}
        self.bpe = tiktoken.Encoding("words", pat_str=r"[^\x00]+", mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = list(map(len, ranks))
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"].encode() for t in json.load(f).get("added_tokens", [])]
        self._clear()

    def _clear(self) -> None:
        self.index: dict[int, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.place, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, codes: list[int], points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        n = ends - starts
        to = np.cumsum(n + 1)
        joined = np.zeros(int(to[-1]), np.uint32)
        offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        # a NUL in a word would end it; its text goes to the tokenizer whole
        joined[np.repeat(to - n - 1, n) + offset] = np.maximum(points[np.repeat(starts, n) + offset], 1)
        width = 1 + (joined > 0x7F) + (joined > 0x7FF).astype(np.int64) + (joined > 0xFFFF)
        width[joined == 0] = 0
        ids = np.array(self.bpe.encode_ordinary(joined.tobytes().decode("utf-32-le")), np.uint32)
        word_end = np.cumsum(width)[to - 1]
        last = np.searchsorted(np.cumsum(self.size[ids]), word_end) + 1
        counts = np.diff(last, prepend=0)
        k = len(self.index)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while k + len(codes) > len(self.place):
            self.place, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.place, self.count))
        self.pool[self.used : self.used + len(ids)] = ids
        self.place[k : k + len(codes)] = self.used + last - counts
        self.count[k : k + len(codes)] = counts
        self.used += len(ids)
        self.index.update(zip(codes, range(k, k + len(codes)), strict=True))

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows in one array, and the offsets of the rows in it."""
        raw = data.tobytes()
        odd = {r for literal in self.special for r in _rows_with(raw, literal, at)}
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        upto = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=upto[1:])
        at = upto[at]
        starts = word_starts(points, at) if len(points) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(points))[: len(starts)]
        codes = span_codes(mix(points.astype(U) + U(1)), starts, ends)
        distinct, where, inverse = np.unique(codes, return_index=True, return_inverse=True)
        if len(self.index) > CACHED_WORDS:
            self._clear()
        keys = distinct.tolist()
        known = self.index
        new = [k for k, c in enumerate(keys) if c not in known]
        if new:
            at_new = where[new]
            self._learn([keys[k] for k in new], points, starts[at_new], ends[at_new])
        k = np.array(list(map(self.index.__getitem__, keys)), np.int64)[inverse] if keys else np.zeros(0, np.int64)
        counts = self.count[k]
        total = np.zeros(len(k) + 1, np.int64)
        np.cumsum(counts, out=total[1:])
        ids = self.pool[np.repeat(self.place[k] - total[:-1], counts) + np.arange(total[-1])]
        rows = total[np.searchsorted(starts, at)]
        if len(points):
            odd.update((np.searchsorted(at, np.flatnonzero(classes()[points] == UNKNOWN), "right") - 1).tolist())
        return self._whole(points, at, ids, rows, odd) if odd else (ids, rows)

    def _whole(self, points: np.ndarray, at: np.ndarray, ids: np.ndarray, rows: np.ndarray, odd: set[int]) -> tuple[np.ndarray, np.ndarray]:
        text = lambda r: points[at[r] : at[r + 1]].tobytes().decode("utf-32-le")
        parts = [np.array(self.tok.encode(text(r), add_special_tokens=False).ids, np.uint32) if r in odd else ids[rows[r] : rows[r + 1]] for r in range(len(rows) - 1)]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A window of a text has as many words as a benchmark item. Only windows that can reach the threshold are fingerprinted:
those in which as many five-word shingles as the threshold asks for stand in items of that size, in whatever order. A
fingerprint has 64 bits and is compared with the items of the window's size. The 64 bits are cut into RADIUS + 1
blocks, so every item within RADIUS differing bits agrees in one block at least; items found by a block are kept if
they are within the radius, and then the shingles with their multiplicities are compared: sum of minima over
sum of maxima >= SIMILARITY. At 0.8 a pair differs in ten bits on average and in more than 24 with a chance below 1e-6.

Windows with the same shingles are fingerprinted once, in bounded steps, so a long text of one repeated word needs no more
memory than another. At 0.8 the blocks are 2 or 3 bits wide and leave most items of a size; it is the count of shared
shingles that keeps the windows few.

Items are held by the tasks in parts of at most PART_ITEMS items and PART_BYTES bytes; a larger benchmark takes several
passes over the texts. The texts are never shuffled, and a passage that many texts hold costs each text the same.

Items or texts of fewer than five words are one shingle, their whole sequence; such an item is found where a text has the
same words in a row. Of equally similar windows of a text the earliest is reported. Nulls: items and texts that are null or have no words match nothing. Repeated items and
rows are reported each. Empty tables give an empty result; without items every row stays. Columns beside doc_id and text
may have any names; `clean` carries them.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import U, grams, mix, sliced, table, text_bytes, words
from .units import column

K = 5
SIMILARITY = 0.8
RADIUS = 24
PART_ITEMS = 20_000
PART_BYTES = 16 << 20
CHUNK = 1 << 16
#: bit ranges of the RADIUS + 1 blocks
EDGES = [64 * k // (RADIUS + 1) for k in range(RADIUS + 2)]


def shingles(codes: np.ndarray) -> np.ndarray:
    return grams(codes, K) if len(codes) >= K else (grams(codes, len(codes)) if len(codes) else codes)


def fingerprints(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The 64 majority bits of each run of shingles; a shingle counts as often as it stands there. At most CHUNK shingles, or one run, are unpacked at once."""
    out, stop = [np.zeros(0, U)], np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        begin = stop[lo] - sizes[lo]
        hi = max(lo + 1, int(np.searchsorted(stop, begin + CHUNK, "right")))
        bits = np.unpackbits(np.ascontiguousarray(mix(flat[begin : stop[hi - 1]])).view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, stop[lo:hi] - sizes[lo:hi] - begin, axis=0, dtype=np.int32)
        out.append(np.packbits(2 * ones > sizes[lo:hi, None], axis=1).view(U).reshape(-1))
        lo = hi
    return np.concatenate(out)


class Index:
    """A part of the benchmark, as arrays."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        data, at = text_bytes(pa.array(texts, pa.string()))
        codes, _, _, upto = words(data, at)
        some = np.flatnonzero(np.diff(upto) > 0)
        self.ids = [ids[k] for k in some.tolist()]
        self.size = np.diff(upto)[some]
        each = [shingles(codes[upto[k] : upto[k + 1]]) for k in some.tolist()]
        n = np.array([len(x) for x in each], np.int64)
        self.flat, self.stop = np.concatenate([np.zeros(0, U), *each]), np.cumsum(n)
        self.prints = fingerprints(self.flat, n)
        self.blocks: dict[int, list[dict[int, np.ndarray]]] = {}
        for m in np.unique(self.size).tolist():
            found = np.flatnonzero(self.size == m)
            self.blocks[m] = []
            for lo, hi in zip(EDGES[:-1], EDGES[1:], strict=True):
                part = (self.prints[found] >> U(lo)) & U((1 << (hi - lo)) - 1)
                self.blocks[m].append({int(v): found[part == v] for v in np.unique(part)})
        # for each number of words in a shingle: its values, and the sizes of the items that hold each
        self.known, self.held, self.maps = {}, {}, {}
        width, size = np.repeat(np.minimum(self.size, K), n), np.repeat(self.size, n)
        for w in np.unique(width).tolist():
            pairs = np.unique(np.rec.fromarrays([self.flat[width == w], size[width == w]]))
            values, first = np.unique(pairs.f0, return_index=True)
            self.known[w], self.held[w] = values, (np.append(first, len(pairs)), np.ascontiguousarray(pairs.f1))
            self.maps[w] = np.zeros(1 << 20, bool)
            self.maps[w][(values >> U(44)).astype(np.int64)] = True

    def item(self, k: int) -> np.ndarray:
        return self.flat[self.stop[k - 1] if k else 0 : self.stop[k]]

    def near(self, m: int, value: int) -> list[int]:
        """Items of m words within RADIUS of a fingerprint."""
        hits = [block.get((value >> lo) & ((1 << (hi - lo)) - 1)) for (lo, hi), block in zip(zip(EDGES[:-1], EDGES[1:], strict=True), self.blocks[m], strict=True)]
        hits = [h for h in hits if h is not None]
        found = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        return found[np.bitwise_count(self.prints[found] ^ U(value)) <= RADIUS].tolist()

    def windows(self, codes: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """(row, start, words) of every window that holds enough shingles of items of its size, sorted."""
        out = [np.zeros((0, 3), np.int64)]
        for w, known in self.known.items():
            g = grams(codes, w)
            p = np.flatnonzero(self.maps[w][(g >> U(44)).astype(np.int64)])
            value = np.minimum(np.searchsorted(known, g[p]), len(known) - 1)
            p, value = p[known[value] == g[p]], value[known[value] == g[p]]
            row = np.searchsorted(upto, p, "right") - 1
            inside = p + w <= upto[row + 1]
            p, row, value = p[inside], row[inside], value[inside]
            first, sizes = self.held[w]
            n = first[value + 1] - first[value]
            m = sizes[np.repeat(first[value] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            p, row = np.repeat(p, n), np.repeat(row, n)
            order = np.lexsort((p, m, row))
            p, row, m = p[order], row[order], m[order]
            cut = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(m, prepend=-1)) if len(p) else p
            for a, b in zip(cut.tolist(), np.append(cut[1:], len(p)).tolist(), strict=False):
                r, size = int(row[a]), int(m[a])
                s = window_starts(p[a:b], int(upto[r]), int(upto[r + 1]), size, w)
                out.append(np.column_stack([np.full(len(s), r), s, np.full(len(s), size)]))
        return np.unique(np.concatenate(out), axis=0)

    def matches(self, data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(row, item, first word, words, similarity): for each row and item the best window, the earliest of equals."""
        codes, _, _, upto = words(data, at)
        todo = self.windows(codes, upto)
        if not len(todo):
            return []
        row, start, m = todo.T
        stop = np.minimum(start + m, upto[row + 1])
        # windows with the same shingles are looked at once; the few without whole shingles are told apart by their place
        every = grams(codes, K)
        total = np.zeros(len(every) + 1, U)
        np.cumsum(mix(every), out=total[1:])
        whole = stop - start >= K
        key = np.where(whole, total[np.where(whole, stop - K + 1, 0)] - total[np.where(whole, start, 0)], start.astype(U))
        _, one, which = np.unique(np.rec.fromarrays([key, m, whole]), return_index=True, return_inverse=True)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        place = defaultdict(dict)  # of each kind of window the rows that have it, with the earliest start
        for r, s, u in zip(row.tolist(), start.tolist(), which.tolist(), strict=True):
            place[u].setdefault(r, s)
        for lo in range(0, len(one), 1024):
            part = one[lo : lo + 1024].tolist()
            runs = [every[start[x] : stop[x] - K + 1] if whole[x] else shingles(codes[start[x] : stop[x]]) for x in part]
            values = fingerprints(np.concatenate(runs), np.array([len(x) for x in runs], np.int64)).tolist()
            for u, (x, own, value) in enumerate(zip(part, runs, values, strict=True), lo):
                for k in self.near(int(m[x]), value):
                    same = weighted_similarity(own, self.item(k))
                    if same >= SIMILARITY:
                        for r, s in place[u].items():
                            if (same, -s) > best.get((r, k), (-1.0, 0, 0))[:2]:
                                best[r, k] = (same, -s, int(m[x]))
        return [(r, k, -s - int(upto[r]), size, same) for (r, k), (same, s, size) in sorted(best.items())]


def window_starts(marked: np.ndarray, lo: int, hi: int, m: int, w: int) -> np.ndarray:
    """Starts of the windows of m words in [lo, hi) whose marked shingles of w words are enough for SIMILARITY.

    With n shingles in the window and k in the item, both / (n + k - both) >= SIMILARITY asks for `need` in both.
    """
    n = min(m, hi - lo) - w + 1
    need = max(1, math.ceil(SIMILARITY * (n + m - w + 1) / (1 + SIMILARITY) - 1e-9))
    if len(marked) < need:
        return marked[:0]
    # a window from s holds the marks `first` to `last` if last - n < s <= first
    first, last = marked[: len(marked) - need + 1], marked[need - 1 :]
    begin, stop = np.maximum(last - n + 1, lo), np.minimum(first, max(lo, hi - m)) + 1
    begin = np.maximum(begin, np.append(lo, np.maximum.accumulate(stop)[:-1]))
    size = np.maximum(stop - begin, 0)
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(nx[i], ny[j]).sum())
    return both / (len(a) + len(b) - both)


def parts(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark in parts of bounded size."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_parts = max(-(-n // PART_ITEMS), -(-size // PART_BYTES))
    for part in range(n_parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts)) == part).collect()  # at most about PART_ITEMS and PART_BYTES
        yield Index([r["item_id"] for r in rows], [r["text"] for r in rows])


FOUND = "doc_id long, item_id long, start_word long, n_words long, similarity double"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each text and item that it holds."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], FOUND)
    for part in parts(benchmark):
        held = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for rows, data, at in sliced(batches):
                found = held.value.matches(data, at)
                row, item, start, n, same = zip(*found, strict=True) if found else ((),) * 5
                yield pa.record_batch(
                    [column(rows, "doc_id").take(pa.array(row, pa.int64())), pa.array([held.value.ids[k] for k in item], pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(same, pa.float64())],
                    ["doc_id", "item_id", "start_word", "n_words", "similarity"],
                )

        out = out.union(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no item, with all their columns."""
    spark = docs.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    now = docs.select(row, "text")
    for part in parts(benchmark):
        held = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for rows, data, at in sliced(batches):
                keep = np.ones(rows.num_rows, bool)
                keep[[m[0] for m in held.value.matches(data, at)]] = False
                yield rows.filter(pa.array(keep))

        now = now.mapInArrow(run, now.schema)
    return now.select("row.*")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

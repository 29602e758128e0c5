"""Exact removal of repeated byte strings by bucket-pointer refinement.

A byte of a text goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id. Suffixes
are not sorted as a whole; they sit in buckets that are refined only while that can change the answer.

1. Every q-gram (q = 24) has a bucket identifier. Each string of LENGTH bytes is owned by the q-gram with the smallest
   identifier among the LENGTH - q + 1 inside it, the leftmost of equals; equal strings have equal owners at equal
   offsets. So the initial buckets hold about one position in fourteen, with the run of string starts that it owns.
2. A bucket is refined by the identifier of all the bytes its members' runs cover. Members of a refined bucket are
   equal throughout: all but those of the smallest document are removed at once.
3. Where a bucket has several refined buckets, what they share is still open. Their strings are refined on, one by one,
   by the bucket identifiers of later offsets, each step from the identifiers of the step before:
   id(48, p) = f(id(24, p), id(24, p + 24)) and id(50, p) = f(id(48, p), id(48, p + 2)), with a second independent
   identifier beside it; again the smallest document stays. Only the bytes of open strings are looked at again.

Strings are told apart by two identifiers whose bits grow with the input (`Bits.enough`): the chance that any two
different strings of the input count as one is below 2 ** -20 up to about 2 ** 47 bytes. Bytes are not compared again.

Texts are dealt into groups of about GROUP_BYTES by a hash, and shuffled once; all three passes read that exchange. Each
refinement decides inside a group first, and sends for every bucket one entry: identifiers and the smallest document.
Of a bucket with several refined buckets in one group only a note goes out that it has them, so a string that stands
in a third of all documents puts one entry for each group into its task. A group's entries are sorted by identifier, cut
into slices of the identifier space, and packed as byte columns with the identifiers as differences, about 11 bytes an
entry. Answers come back as one byte an entry in the same order, so that no position is ever sent; the group computes
its order again. A slice has a share of the identifiers, not of the texts, and their number grows with the bytes.

Nulls: a null text is empty. A document without id counts as larger than all others. Rows with the same id don't
remove each other's bytes; rows equal in id and text share a group. Texts shorter than LENGTH stay whole. A text is
looked at in steps of STEP string starts, so one very long text needs about fifteen times its own size in its task. Ties
don't arise: bytes go by the smallest document alone. Columns beside doc_id and text are ignored, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import _STEP, BYTE_CODE, U, mix, powers, runs, table, text_bytes

LENGTH = 50
Q = 24
REACH = LENGTH - Q + 1
GROUP_BYTES = 8 << 20
#: string starts that are looked at together, whatever the sizes of the texts; their places fit PLACE_BITS bits
STEP = 1 << 18
PLACE_BITS = 20
#: text bytes for each slice of the identifier space
SLICE_TEXT = 32 << 20
SPARE_BITS = 20
GONE, SEVERAL = 1, 2
ENTRIES = "g long, slice long, data binary"


@dataclass
class Bits:
    """Bits kept of the two identifiers of an entry, in the refinement of buckets and in that of strings."""

    bucket: tuple[int, int]
    string: tuple[int, int]

    @classmethod
    def enough(cls, n_bytes: int) -> Bits:
        """Two different strings among n_bytes share an entry with a chance below 2 ** -SPARE_BITS."""
        need = 2 * max(n_bytes, 1).bit_length() + SPARE_BITS
        rest = lambda first: min(64, max(32, -(-(need - first) // 8) * 8))
        return cls((56, rest(56)), (60, rest(60)))

    @property
    def note(self) -> np.uint64:
        return U((1 << self.bucket[1]) - 1)


def _joined(ids: np.ndarray, step: int) -> np.ndarray:
    """Identifiers of twice the depth from those `step` later; the last ones are not used."""
    out = ids * _STEP
    out[: len(out) - step] += ids[step:]
    return mix(out)


class Windows:
    """Identifiers of byte windows of one array, from sums of coded bytes."""

    def __init__(self, data: np.ndarray) -> None:
        self.n = len(data)
        up, self.down = powers(self.n)
        self.total = np.zeros(self.n + 1, U)
        coded = BYTE_CODE[data]
        coded *= up[: self.n]
        np.cumsum(coded, out=self.total[1:])

    def of(self, width: int) -> np.ndarray:
        """The window from each place that has one, not yet mixed."""
        m = max(self.n - width + 1, 0)
        out = self.total[width : width + m] - self.total[:m]
        out *= self.down[:m]
        return out

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.total[stop] - self.total[start]) * self.down[start]


def string_ids(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two identifiers of the LENGTH bytes from each start: from the buckets of later offsets, and from the bytes.

    The bytes that no start needs are left out first.
    """
    need = covered(len(data), starts, starts + LENGTH)
    place = np.cumsum(need, dtype=np.int32)
    w = Windows(data[need])
    starts = place[starts] - 1
    deep = _joined(_joined(mix(w.of(Q)), Q), LENGTH - 2 * Q)[starts]  # 24, 48, and 48 with the 48 that begin 2 later: 50
    return deep, mix(w.spans(starts, starts + LENGTH))


def owners(grams: np.ndarray) -> np.ndarray:
    """For each start the place of the smallest of the REACH identifiers from it, leftmost of equals."""
    low = U((1 << PLACE_BITS) - 1)
    least = grams & ~low
    least |= np.arange(len(least), dtype=U)
    width = 1
    while width < REACH:
        step = min(width, REACH - width)
        if len(least) <= step:
            break
        least = np.minimum(least[:-step], least[step:])
        width += step
    return (least & low).astype(np.int64)


def string_runs(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and last start, bucket identifier and refined identifier of every owner's run; `starts` are the string starts in data."""
    if not len(starts):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, U),) * 2
    w = Windows(data)
    grams = w.of(Q)
    own = owners(grams)[starts]
    cut = np.flatnonzero(np.diff(own, prepend=-1))
    lo, hi = starts[cut], starts[np.append(cut[1:], len(starts)) - 1]
    own = own[cut]
    shape = ((own - lo) * 64 + (hi - own)).astype(U)
    return lo, hi, mix(grams[own]), mix(w.spans(lo, hi + LENGTH) + mix(shape + U(1)))


def pack(*columns: np.ndarray) -> bytes:
    """Unsigned columns as little-endian byte planes, each as wide as its largest value needs."""
    out = []
    for c in columns:
        width = (int(c.max()).bit_length() + 7) // 8 if len(c) else 0
        planes = np.ascontiguousarray(c.astype(U)).view(np.uint8).reshape(-1, 8)[:, :width]
        out += [np.array([len(c), width], "<u4").tobytes(), np.ascontiguousarray(planes.T).tobytes()]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, width = np.frombuffer(data, "<u4", 2, at).tolist()
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 8).reshape(width, n).T
        out.append(wide.view(U).reshape(-1))
        at += 8 + n * width
    return out


def steps(sorted_values: np.ndarray) -> np.ndarray:
    """Differences of sorted values, the first one whole; np.cumsum undoes it."""
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0))


@dataclass
class Classes:
    """Members in the order of bucket, refined bucket and document."""

    order: np.ndarray
    new_bucket: np.ndarray
    new_class: np.ndarray
    least: np.ndarray  # the smallest document of the member's refined bucket
    later: np.ndarray  # the member's own document is larger


def classes(hi: np.ndarray, lo: np.ndarray, ords: np.ndarray) -> Classes:
    n = len(hi)
    order = np.argsort(hi)
    sorted_hi = hi[order]
    again = np.zeros(n, bool)
    again[1:] = sorted_hi[1:] == sorted_hi[:-1]
    new_bucket = ~again
    again[:-1] |= again[1:]
    some = order[again]
    order[again] = some[np.lexsort((ords[some], lo[some], hi[some]))]
    low, own = lo[order], ords[order]
    new_class = new_bucket.copy()
    new_class[1:] |= low[1:] != low[:-1]
    least = own[np.maximum.accumulate(np.where(new_class, np.arange(n), 0))] if n else own
    return Classes(order, new_bucket, new_class, least, own > least)


def packed_entries(g: int, n_slices: int, bits: int, hi: np.ndarray, lo: np.ndarray, ords: np.ndarray) -> list[tuple[int, int, bytes]]:
    """One row for each slice of the identifier space that the sorted identifiers hi reach into."""
    if not len(hi):
        return []
    part = ((hi >> U(bits - 32)) * U(n_slices)) >> U(32)
    cut = np.flatnonzero(np.diff(part, prepend=part[0] + U(1)))
    out = []
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(hi)], strict=True):
        base = ords[a:b].min()
        out.append((g, int(part[a]), pack(steps(hi[a:b]), lo[a:b], (ords[a:b] - base).astype(U), np.array([int(base) + 2**63], U))))
    return out


def _entry_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    g, part, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table([pa.array(g, pa.int64()), pa.array(part, pa.int64()), pa.array(data, pa.binary())], ["g", "slice", "data"])


def answers(note_as: np.uint64 | None) -> Callable[[pa.Table], pa.Table]:
    """Decides one slice of the identifier space for all groups: a byte for each entry. Slices below 0 are letters of a group to itself.

    With `note_as` the entries are of buckets, and those with this second identifier are notes.
    """

    def run(entries: pa.Table) -> pa.Table:
        if entries["slice"][0].as_py() < 0:
            return entries.select(["g", "slice", "data"])
        parts = [unpack(x) for x in entries["data"].to_pylist()]
        hi = np.concatenate([np.cumsum(p[0]) for p in parts])
        lo = np.concatenate([p[1] for p in parts])
        ords = np.concatenate([(p[2] + p[3][0] - U(2**63)).view(np.int64) for p in parts])
        note = np.zeros(len(lo), bool) if note_as is None else lo == note_as
        c = classes(hi, lo, ords)
        flags = (c.later & ~note[c.order]).astype(np.uint8) * GONE
        if note_as is not None:
            first = np.flatnonzero(c.new_bucket)
            many = np.add.reduceat(c.new_class.astype(np.int64), first) > 1
            flags |= np.repeat(many, np.diff(np.append(first, len(hi)))).astype(np.uint8) * SEVERAL
        back = np.zeros(len(hi), np.uint8)
        back[c.order] = flags
        ends = np.cumsum([len(p[0]) for p in parts])[:-1]
        out = [x.tobytes() for x in np.split(back, ends)]
        return pa.table([entries["g"], entries["slice"], pa.array(out, pa.binary())], ["g", "slice", "data"])

    return run


def told(replies: pa.Table) -> np.ndarray:
    """The answers to a group in the order of its entries."""
    pairs = sorted(zip(replies["slice"].to_pylist(), replies["data"].to_pylist(), strict=True))
    return np.frombuffer(b"".join(d for s, d in pairs if s >= 0), np.uint8)


def told_parts(replies: pa.Table, n: int) -> list[np.ndarray]:
    """Answers of n packed columns to a group, in the order of its entries."""
    pairs = sorted(zip(replies["slice"].to_pylist(), replies["data"].to_pylist(), strict=True))
    parts = [unpack(d) for _, d in pairs]
    return [np.concatenate([p[k] for p in parts]) for k in range(n)]


class Group:
    """The texts of one group in the order of documents, with the members of the initial buckets."""

    def __init__(self, texts: pa.Table, bits: Bits, members: bool = True) -> None:
        self.rows = texts.sort_by([("ord", "ascending"), ("k", "ascending")])
        self.data, self.at = text_bytes(self.rows["text"])
        self.ords = self.rows["ord"].to_numpy()
        self.g = self.rows["g"][0].as_py()
        self.bits = bits
        if not members:
            return
        long = np.diff(self.at) >= LENGTH
        begin, end = self.at[:-1][long], self.at[1:][long] - LENGTH + 1
        found = []
        for x in range(0, len(self.data), STEP):
            i, j = np.searchsorted(end, x, "right"), np.searchsorted(begin, x + STEP)
            lo, hi = np.maximum(begin[i:j], x) - x, np.minimum(end[i:j], x + STEP) - x
            first, last, key, ctx = string_runs(self.data[x : x + STEP + LENGTH], np.flatnonzero(covered(STEP, lo, hi)))
            found.append(((first + x).astype(np.uint32), (last + x).astype(np.uint32), key, ctx))
        none = (np.zeros(0, np.uint32),) * 2 + (np.zeros(0, U),) * 2
        self.first, self.last, key, ctx = (np.concatenate(v) for v in zip(none, *found, strict=True))
        self.hi, self.lo = key >> U(64 - bits.bucket[0]), np.minimum(ctx >> U(64 - bits.bucket[1]), bits.note - U(1))
        self.c = c = classes(self.hi, self.lo, self.ords[np.searchsorted(self.at, self.first, "right") - 1])
        self.head = np.flatnonzero(c.new_bucket)
        count = np.add.reduceat(c.new_class.astype(np.int64), self.head) if len(self.head) else self.head
        self.several = count > 1

    def entries(self, n_slices: int) -> list[tuple[int, int, bytes]]:
        at = self.c.order[self.head]
        return packed_entries(self.g, n_slices, self.bits.bucket[0], self.hi[at], np.where(self.several, self.bits.note, self.lo[at]), self.c.least[self.head])

    def strings(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, Classes]:
        """Identifiers and classes of the strings from each start."""
        found = [(np.zeros(0, U), np.zeros(0, U))]
        cut = np.searchsorted(start, np.arange(0, len(self.data) + STEP, STEP))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            x = k * STEP
            found.append(string_ids(self.data[x : x + STEP + LENGTH], start[cut[k] : cut[k + 1]] - x))
        hi, lo = (np.concatenate(v) >> U(64 - n) for v, n in zip(zip(*found, strict=True), self.bits.string, strict=True))
        return hi, lo, classes(hi, lo, self.ords[np.searchsorted(self.at, start, "right") - 1])

    def open_strings(self, flags: np.ndarray, n_slices: int) -> list[tuple[int, int, bytes]]:
        """Entries of the strings that are still open, and a letter: runs of bytes that go, and runs of open starts."""
        c, size = self.c, np.diff(np.append(self.head, len(self.c.order)))
        gone = c.later | np.repeat((flags & GONE > 0) & ~self.several, size)
        todo = ~gone & np.repeat(self.several | (flags & SEVERAL > 0), size)
        first, last = self.first.astype(np.int64), self.last.astype(np.int64)
        lost = covered(len(self.data), first[c.order[gone]], last[c.order[gone]] + LENGTH)
        todo = covered(len(self.data), first[c.order[todo]], last[c.order[todo]] + 1)
        hi, lo, s = self.strings(np.flatnonzero(todo))
        at = s.order[s.new_class]
        out = packed_entries(self.g, n_slices, self.bits.string[0], hi[at], lo[at], s.least[s.new_class])
        spans = [runs(x, np.array([0]))[:2] for x in (lost, todo)]
        letter = pack(*(v for a, b in spans for v in (steps(a), b - a)))
        return [*out, (self.g, -1 - self.g, letter)] if lost.any() or todo.any() else out

    def result(self, replies: pa.Table) -> pa.Table:
        data, at, n = self.data, self.at, len(self.ords)
        lost = np.zeros(len(data), bool)
        for letter in (d for s, d in zip(replies["slice"].to_pylist(), replies["data"].to_pylist(), strict=True) if s < 0):
            a, size, todo, n_todo = (v.astype(np.int64) for v in unpack(letter))
            a, todo = np.cumsum(a), np.cumsum(todo)
            start = np.flatnonzero(covered(len(data), todo, todo + n_todo))
            if len(start):
                s = self.strings(start)[2]
                again = start[s.order[s.later | (told(replies)[np.cumsum(s.new_class) - 1] > 0)]]
                a, size = np.concatenate([a, again]), np.append(size, np.full(len(again), LENGTH))
            lost = covered(len(data), a, a + size)
        start, stop, cut = runs(lost, at) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64))
        spans = np.diff(cut)
        row = np.repeat(np.arange(n), spans)
        n_lost = np.bincount(row, weights=stop - start, minlength=n).astype(np.int64)
        sha = []
        for a, b, some in zip(at[:-1].tolist(), at[1:].tolist(), spans.tolist(), strict=True):
            sha.append(hashlib.sha256((data[a:b][~lost[a:b]] if some else data[a:b]).tobytes()).hexdigest())
        pairs = pa.StructArray.from_arrays([pa.array(start - at[row], pa.int64()), pa.array(stop - at[row], pa.int64())], ["start", "stop"])
        lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pairs)
        values = [self.rows["doc_id"].cast(pa.int64()), pa.array(np.diff(at)), pa.array(n_lost), pa.array(spans.astype(np.int64)), pa.array(sha, pa.string()), lists]
        return pa.table(values, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def covered(n: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """True at the places of 0 to n - 1 that lie in one of the spans [start, stop); spans may be in any order and overlap."""
    edge = np.zeros(n + 1, np.int8)
    if len(start):
        if (start[1:] < start[:-1]).any():
            order = np.argsort(start)
            start, stop = start[order], stop[order]
        reach = np.maximum.accumulate(stop)
        new = np.ones(len(start), bool)
        new[1:] = start[1:] > reach[:-1]
        edge[start[new]] = 1
        edge[np.minimum(reach[np.append(np.flatnonzero(new)[1:], len(start)) - 1], n)] -= 1
    return np.cumsum(edge[:n], dtype=np.int8).view(bool)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"


def repeated_strings(docs: DataFrame) -> DataFrame:
    """One row a document: n_bytes, n_removed, n_spans, kept_sha256 and the removed spans as byte offsets of the text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_groups, bits = total // GROUP_BYTES + 1, Bits.enough(total)
    n_slices = max(total // SLICE_TEXT, 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("ord"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    groups = texts.withColumn("g", F.pmod(F.xxhash64("ord", "k"), F.lit(n_groups))).repartition("g")

    def members(texts: pa.Table) -> pa.Table:
        return _entry_table(Group(texts, bits).entries(n_slices))

    def open_strings(texts: pa.Table, replies: pa.Table) -> pa.Table:
        return _entry_table(Group(texts, bits).open_strings(told(replies), n_slices))

    def result(texts: pa.Table, replies: pa.Table) -> pa.Table:
        return Group(texts, bits, members=False).result(replies)

    first = groups.groupBy("g").applyInArrow(members, ENTRIES).groupBy("slice").applyInArrow(answers(bits.note), ENTRIES)
    second = groups.groupBy("g").cogroup(first.groupBy("g")).applyInArrow(open_strings, ENTRIES).groupBy("slice").applyInArrow(answers(None), ENTRIES)
    return groups.groupBy("g").cogroup(second.groupBy("g")).applyInArrow(result, RESULT)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(table(spark, sf_dir, "documents")).drop("spans")

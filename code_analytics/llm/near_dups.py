"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

A document's set is its distinct shingles of five words (lower-cased, whole text). The sketch is that of Dahlgaard,
Knudsen and Thorup (2017): in round i every shingle is hashed to a bin and a value, and a bin keeps the
smallest value of the earliest round that reached it; rounds t to 2t - 1 send everything to one bin each, so every
coordinate is filled after 2t rounds whatever the size of the set, and the coordinates concentrate like sampling with
replacement. A long text fills nearly all bins in the first round.

T coordinates make T / R bands. At a threshold of 0.85 a band of R = 4 agrees with probability 0.52, so a linked pair
shares none of the 24 bands with probability below 3e-8; at 0.8, which the pipeline takes, below 4e-6.

Equal word sequences (by digests of 128 bits) are one class, and only classes are compared. A band bucket with several classes is a group; equal
groups of different bands are taken once. The texts of its classes are brought to it and all its links are
found from whole sets with an inverted list of the shingles that at least two members have (a product of incidence
blocks); a spanning forest of the links goes on. A bucket of more than BLOCK classes is dealt out in blocks, and
only classes that are still in different components meet across blocks, so no task holds more than two blocks and
a large group of near copies isn't compared with itself again and again. The links become components by alternating large-star and
small-star steps (Kiveris et al., 2014), with the edges written to the shared folder after each.

Nulls and texts without words: an empty set, linked with nothing; such a row is its own component. A null doc_id never
is a smallest id; a row without id is kept only where its component has no id at all. Rows with equal text are one class
whatever their ids. Rows that share an id share no link by that alone. A very long text is sketched inside its task. Columns
beside doc_id and text may have any names; `one_of_each` carries them. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import U, grams, mix, shingle_sets, signed, sliced, stored, table, words
from .line_dedup import few
from .units import column, key_of, ord_of

K = 5
T = 96
R = 4
BLOCK = 512
PERCENT = 85
BROADCAST_ROWS = 2_000_000


def sketches(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """One row of t coordinates for each set that is not empty (others keep zeros)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), t), U)
    filled = np.zeros((len(sets), t), bool)
    filled[sizes == 0] = True
    items = np.concatenate(sets) if sets else np.zeros(0, U)
    owner = np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * t):
        if not len(items):
            break
        h = mix(items + U((0x9E3779B97F4A7C15 * (i + 1)) & (2**64 - 1)))
        slot = owner * t + ((h >> U(40)) % U(t)).astype(np.int64) if i < t else owner * t + (i - t)
        best = np.full(len(sets) * t, np.iinfo(np.uint64).max, U)
        np.minimum.at(best, slot, h)
        best = best.reshape(len(sets), t)
        new = ~filled & (best != np.iinfo(np.uint64).max)
        out[new] = best[new]
        filled |= new
        todo = ~filled.all(axis=1)
        if not todo.any():
            break
        more = todo[owner]
        items, owner = items[more], owner[more]
    return out


def bands(sketch: np.ndarray, r: int = R) -> np.ndarray:
    n, t = sketch.shape
    parts = sketch.reshape(n, t // r, r)
    h = np.broadcast_to(np.arange(t // r).astype(U), (n, t // r)).copy()
    for j in range(r):
        h = mix(h + parts[:, :, j])
    return h


SKETCH = "doc_id long, k binary, node binary, n_shingles long, bands array<long>"


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, k (a hash of the text), node (the class of the word sequence; null without words), n_shingles and band keys of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in sliced(batches):
            codes, _, _, upto = words(data, at)
            sets = shingle_sets(codes, upto, K)
            keys = bands(sketches(sets))
            size = np.array([len(s) for s in sets], np.int64)
            lists = pa.ListArray.from_arrays(pa.array((np.arange(len(sets) + 1) * keys.shape[1]).astype(np.int32)), pa.array(signed(keys).reshape(-1)))
            node = as_binary(classes(codes, upto), size > 0)
            yield pa.record_batch([column(rows, "doc_id"), column(rows, "k"), node, pa.array(size), lists], ["doc_id", "k", "node", "n_shingles", "bands"])

    return docs.select(F.col("doc_id").cast("long"), key_of().alias("k"), "text").mapInArrow(run, SKETCH)


def classes(codes: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """A digest of 128 bits of each row's whole word sequence, as two columns."""
    place = mix((np.arange(len(codes)) - np.repeat(upto[:-1], np.diff(upto))).astype(U) + U(1))
    out = np.zeros((len(upto) - 1, 2), U)
    for k, mixed in enumerate((mix(codes + place), mix((codes >> U(7)) * codes + U(3) * place))):
        total = np.zeros(len(codes) + 1, U)
        np.cumsum(mixed, out=total[1:])
        out[:, k] = mix(total[upto[1:]] - total[upto[:-1]] + np.diff(upto).astype(U))
    return out


def as_binary(pairs: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """Rows of two numbers as strings of 16 bytes."""
    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(pairs), [None, pa.py_buffer(np.ascontiguousarray(pairs))]).cast(pa.binary())
    return raw if valid is None else pc.if_else(pa.array(valid), raw, pa.scalar(None, pa.binary()))


def linked(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 |a & b| >= percent |a | b|."""
    n = len(sets)
    parent = list(range(n))

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []

    def join(a: int, b: int) -> None:
        if (x := root(a)) != (y := root(b)):
            parent[y] = x
            out.append((a, b))

    size = np.array([len(s) for s in sets], np.int64)
    if n <= 4:
        for a in range(n):
            for b in range(a + 1, n):
                if min(size[a], size[b]) * 100 >= percent * max(size[a], size[b]) and root(a) != root(b):
                    both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    if 100 * both >= percent * (size[a] + size[b] - both):
                        join(a, b)
        return out
    items, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    _, inverse, counts = np.unique(items, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    alive = np.bincount(owner[twice], minlength=n) * 100 >= percent * size  # else too much of it is nowhere else
    keep = twice & alive[owner]
    rows = np.flatnonzero(alive)
    if len(rows) < 2:
        return out
    at = np.cumsum(alive) - 1
    _, column = np.unique(inverse[keep], return_inverse=True)
    row = at[owner[keep]]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    both = np.zeros((len(rows), len(rows)), np.float32)
    width = 2048
    for lo in range(0, int(column[-1]) + 1, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        block = np.zeros((len(rows), width), np.float32)
        block[row[a:b], column[a:b] - lo] = 1
        both += block @ block.T
    s = size[rows]
    hit = 100 * both >= percent * (s[:, None] + s[None, :] - both)
    for a, b in zip(*np.nonzero(np.triu(hit, 1)), strict=True):
        join(int(rows[a]), int(rows[b]))
    return out


def group_links(batches: Iterator[pa.RecordBatch], percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """Reads the members of groups, sorted by (bkey, i, j); holds one group, which has two blocks at most."""
    held: tuple | None = None
    sets: list[np.ndarray] = []
    nodes: list[bytes] = []
    found: list[tuple[bytes, bytes]] = []

    def close() -> None:
        if len(nodes) > 1:
            found.extend((nodes[a], nodes[b]) for a, b in linked(sets, percent))

    for rows, data, at in sliced(batches):
        codes, _, _, upto = words(data, at)
        these = shingle_sets(codes, upto, K)
        keys = list(zip(*(rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("bkey", "i", "j")), strict=True))
        for key, node, s in zip(keys, rows.column(rows.schema.get_field_index("node")).to_pylist(), these, strict=True):
            if key != held:
                close()
                held, sets, nodes = key, [], []
            sets.append(s)
            nodes.append(node)
        if found:
            yield pa.record_batch([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["a", "b"])
            found = []
    close()
    if found:
        yield pa.record_batch([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["a", "b"])


def linked_roots(docs: DataFrame, drawn: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, root) of the classes that are linked with another one. `drawn` is the stored sketch table of `docs`.

    Blocks of a bucket are compared within themselves first; then, across blocks, the classes of a bucket that are
    still in different components (`apart`).
    """
    reps = drawn.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    keyed = stored(reps.select("node", F.explode("bands").alias("bkey")))
    buckets = keyed.groupBy("bkey").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("s1"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("s2"))
    once = buckets.where("m > 1").groupBy("m", "s1", "s2").agg(F.min("bkey").alias("bkey")).select("bkey", F.ceil(F.col("m") / BLOCK).cast("int").alias("nb"))
    members = stored(keyed.join(once, "bkey").select("bkey", "node", "nb", part(F.col("nb")).alias("i")))
    rooted = components(compared(docs, members.select("bkey", "i", F.col("i").alias("j"), "node"), percent))
    large = members.where("nb > 1").select("bkey", "node")
    if large.isEmpty():
        return rooted
    placed = large.join(rooted, "node", "left").select("bkey", "node", F.coalesce("root", "node").alias("root"))
    placed = stored(placed)
    several = placed.groupBy("bkey").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bkey")
    placed = stored(placed.join(several, "bkey"))
    if placed.isEmpty():
        return rooted
    more = stored(compared(docs, stored(apart(placed)), percent))
    return rooted if more.isEmpty() else components(rooted.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))


def part(parts: Column) -> Column:
    """Which of so many parts a class belongs to."""
    return F.pmod(F.xxhash64("node", F.lit(3)), parts).cast("string")


def apart(placed: DataFrame) -> DataFrame:
    """All classes of a bucket, so that every two in different components meet.

    A component of half a block or more has blocks of its own, which don't meet each other; the rest share blocks.
    So the m classes of a bucket move m / BLOCK times only where they really fall into many components.
    """
    size = placed.groupBy("bkey", "root").agg(F.count("*").alias("n")).withColumn("owner", F.when(F.col("n") * 2 >= BLOCK, F.hex("root")).otherwise(""))
    owners = stored(size.groupBy("bkey", "owner").agg(F.ceil(F.sum("n") / BLOCK).alias("parts")))
    name = lambda sub: F.concat("owner", F.lit("-"), sub)
    blocks = owners.select("bkey", "owner", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("sub")).select("bkey", "owner", name(F.col("sub").cast("string")).alias("i"))
    others = blocks.select("bkey", F.col("owner").alias("owner_j"), F.col("i").alias("j"))
    pairs = blocks.join(others, "bkey").where("owner <> owner_j and i < j or owner = '' and owner_j = '' and i <= j")
    tasks = pairs.select("bkey", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    own = placed.join(size.select("bkey", "root", "owner"), ["bkey", "root"]).join(owners, ["bkey", "owner"]).select("bkey", name(part(F.col("parts"))).alias("block"), "node")
    return own.join(tasks, ["bkey", "block"]).select("bkey", "i", "j", "node")


def compared(docs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each group of a stored table (bkey, i, j, node) a spanning forest of its links."""
    wanted = stored(groups.select("node").distinct())
    # while the wanted classes are few, only their texts are moved
    texts = class_texts(docs).join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "node").groupBy("node").agg(F.first("text").alias("text"))
    grouped = groups.join(texts, "node").select("bkey", "i", "j", "node", "text").repartition("bkey", "i", "j").sortWithinPartitions("bkey", "i", "j")
    return grouped.mapInArrow(lambda batches: group_links(batches, percent), "a binary, b binary").distinct()


def class_texts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in sliced(batches):
            codes, _, _, upto = words(data, at)
            digests = classes(codes, upto)
            where = np.unique(digests, axis=0, return_index=True)[1]
            where = where[np.diff(upto)[where] > 0]
            yield pa.record_batch([as_binary(digests[where]), rows.column(0).take(pa.array(where))], ["node", "text"])

    return docs.select("text").mapInArrow(run, "node binary, text string")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its component."""
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = mark
        # large star: neighbours above a node go to the smallest one around it
        around = both(now)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = stored(around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # small star: a node and its neighbours below go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = stored(small.where("a <> b").distinct())


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, k, n_shingles, component_id, kept, root (the component) and one (whether the row stands for it) of each row."""
    drawn = stored(sketched(docs))
    roots = linked_roots(docs, drawn, percent)
    rows = drawn.select("doc_id", "k", "node", "n_shingles").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    place = F.struct(ord_of().alias("ord"), "k")
    # a table of its own, so that Spark may split a large component in the join
    smallest = stored(rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"), F.min(place).alias("first")))
    out = rows.join(smallest, "root", "left").withColumn("component_id", F.coalesce("least", "doc_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return out.select("doc_id", "k", "n_shingles", "component_id", kept.alias("kept"), "root", F.coalesce(place == F.col("first"), F.lit(True)).alias("one"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs`, with all their columns, less those for which another document of their component stays.

    Rows without words all stay. Rows with the same id and text are one document and stay together.
    """
    gone = near_duplicates(docs, percent).where(~F.col("one")).select(ord_of().alias("ord"), "k").distinct()
    whole = docs.select(ord_of().alias("_ord"), key_of().alias("_k"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return whole.join(few(gone), (F.col("_ord") == F.col("ord")) & (F.col("_k") == F.col("k")), "left_anti").select("_row.*")


def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")

"""Vector code compression: product codes whose nearest entries are found by Orchard's search.

Each component x counts as the integer floor(256 x). A vector is cut into equal parts, and each part position has a
codebook of at most `n_entries` entries, which begins as that part of the vectors with the smallest ids. A round assigns
every part to its nearest entry and moves each entry to the floored mean of its parts. Tasks add up counts and sums of
their rows, so what reaches the driver has a fixed size: the codebooks.

Orchard's search: every entry has the list of all entries by their distance to it. A search stands at an entry, walks its
list, and jumps to the list of an entry that is nearer; entries looked at are marked and not looked at again. It ends
where the list goes beyond twice the distance of the entry it stands at, since no entry behind can be nearer. Whole batches
of parts walk at once. All distances are squared and in integers, and of equally near entries the lowest index wins.

Vectors that are null, empty, of another length than that of the smallest id, or hold a null or non-finite component take
no part. Components are held within +-2^27, which keeps squared distances within 64 bits. A length that `n_parts` doesn't
divide is filled up with zeros. A null vec_id stays null and counts as larger than all others; repeated rows are coded each;
of rows with the smallest ids that share an id the smaller vector goes first. Long vectors are long rows and no more. Columns
beside vec_id, embedding and label are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import stored, table
from .units import column
from .vectors import dimensions, finite, joined_by_hot_keys, matrix

SCALE = 256
LARGEST = 1 << 27
BLOCK = 8_192


def whole(x: np.ndarray, n_parts: int) -> np.ndarray:
    """Vectors as integers, (rows, parts, components of a part)."""
    q = np.clip(np.floor(x.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64)
    if fill := -q.shape[1] % n_parts:
        q = np.pad(q, ((0, 0), (0, fill)))
    return q.reshape(len(q), n_parts, q.shape[1] // n_parts)


class Orchard:
    """The sorted neighbour lists of one codebook."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.n = len(entries)
        apart = ((entries[:, None] - entries[None]) ** 2).sum(axis=2)
        self.lists = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.lists, axis=1)
        self.by_first = np.argsort(entries[:, 0], kind="stable")
        self.firsts = entries[self.by_first, 0]

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row, the lowest of equally near ones, and its squared distance."""
        out = [self._walk(x[lo : lo + BLOCK]) for lo in range(0, len(x), BLOCK)]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])

    def _walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # the walk may begin anywhere; the entry next to the row in the first component is near more often than not
        best = self.by_first[np.minimum(np.searchsorted(self.firsts, x[:, 0]), self.n - 1)]
        near = ((x - self.entries[best]) ** 2).sum(axis=1)
        place = np.zeros(len(x), np.int64)
        marked = np.zeros((len(x), self.n), bool)
        marked[np.arange(len(x)), best] = True
        walking = np.arange(len(x))
        while len(walking):
            at, k = best[walking], place[walking]
            # distances are squared: beyond twice the distance is beyond four times its square
            walking = walking[self.apart[at, k] <= 4 * near[walking]]
            at, k = best[walking], place[walking]
            e = self.lists[at, k]
            place[walking] = k + 1
            new = ~marked[walking, e]
            rows, e = walking[new], e[new]
            marked[rows, e] = True
            d = ((x[rows] - self.entries[e]) ** 2).sum(axis=1)
            better = (d < near[rows]) | ((d == near[rows]) & (e < best[rows]))
            rows, e = rows[better], e[better]
            best[rows], near[rows], place[rows] = e, d[better], 0
            walking = walking[place[walking] < self.n]
        return best, near


def codebook_sums(vectors: DataFrame, books: list[np.ndarray], n: int) -> dict[tuple[int, int], tuple[int, np.ndarray]]:
    """For each (part, entry) that is used how many parts it has and their sums; at most parts x entries x (components + 1) rows reach the driver."""
    width = books[0].shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [Orchard(b) for b in books]
        total = np.zeros((len(books), len(books[0]), width + 1), np.int64)
        for b in batches:
            x = whole(matrix(column(b, "embedding"), n)[1], len(books))
            for p, orchard in enumerate(lists):
                np.add.at(total[p], orchard.search(x[:, p])[0], np.column_stack([np.ones(len(x), np.int64), x[:, p]]))
        part, entry = np.nonzero(total[:, :, 0])
        some = total[part, entry].reshape(-1)
        part, entry = np.repeat(part, width + 1), np.repeat(entry, width + 1)
        place = np.tile(np.arange(width + 1), len(some) // (width + 1))
        yield pa.record_batch([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(place, pa.int32()), pa.array(some)], ["part", "entry", "place", "v"])

    rows = vectors.select("embedding").mapInArrow(add, "part int, entry int, place int, v long").groupBy("part", "entry", "place").agg(F.sum("v").alias("v")).collect()
    sums: dict[tuple[int, int], np.ndarray] = {}
    for r in rows:
        sums.setdefault((r["part"], r["entry"]), np.zeros(width + 1, object))[r["place"]] = r["v"]
    return {k: (v[0], v[1:]) for k, v in sums.items()}


def codebooks(vectors: DataFrame, n: int, n_parts: int = 16, n_entries: int = 64, rounds: int = 2) -> list[np.ndarray]:
    """The final entries of each part."""
    first = vectors.where(finite() & (F.size("embedding") == n)).orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(n_entries).collect()
    seeds = whole(np.array([r["embedding"] for r in first], np.float64), n_parts)
    books = [seeds[:, p].copy() for p in range(n_parts)]
    for _ in range(rounds):
        for (part, entry), (count, total) in codebook_sums(vectors, books, n).items():
            books[part][entry] = [int(s) // int(count) for s in total]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for v in book.reshape(-1).tolist()).encode()).hexdigest()


def encoded(vectors: DataFrame, books: list[np.ndarray], n: int) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error, the summed squared distance, of each usable vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [Orchard(b) for b in books]
        for b in batches:
            rows, x = matrix(column(b, "embedding"), n)
            x = whole(x, len(books))
            codes, error = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
            for p, orchard in enumerate(lists):
                codes[:, p], d = orchard.search(x[:, p])
                error += d
            code = pa.array([c.tobytes().hex() for c in codes], pa.string())
            yield pa.record_batch([column(b, "vec_id").take(pa.array(rows)), column(b, "label").take(pa.array(rows)), code, pa.array(error)], ["vec_id", "label", "code", "error"])

    kinds = dict(vectors.dtypes)
    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compressed(vectors: DataFrame, n_parts: int = 16, n_entries: int = 64, rounds: int = 2) -> DataFrame:
    """vec_id, code, error, label_error (the errors of equal labels, nulls together) and codebooks_sha256 of each usable vector."""
    vectors = vectors.select("vec_id", "embedding", "label")
    n = dimensions(vectors)
    if not n:
        return vectors.limit(0).select(F.col("vec_id").cast("long"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = codebooks(vectors, n, n_parts, n_entries, rounds)
    rows = stored(encoded(vectors, books, n).select(F.col("vec_id").cast("long"), F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("same"), "code", "error"))
    sums = rows.groupBy("same").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    out = joined_by_hot_keys(rows, sums, "same", rows.count(), "n")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: 16 parts, 64 entries, two rounds."""
    return compressed(table(spark, sf_dir, "embeddings"))


def _assign(name: str, book: str) -> str:
    return f"""{name} as (select vec_id, row_id, label, part, arg_min(entry, (d, entry)) as entry, min(d) as d from (
  select v.*, e.entry, (v.a-e.a)*(v.a-e.a)+(v.b-e.b)*(v.b-e.b)+(v.c-e.c)*(v.c-e.c)+(v.d0-e.d0)*(v.d0-e.d0) as d from v join {book} e using (part)) group by all)"""


def _mean(name: str, assigned: str, book: str) -> str:
    mean = lambda c: f"coalesce(cast(floor(sum(v.{c})/count(v.{c})) as bigint), any_value(e.{c})) as {c}"
    return f"""{name} as (select e.part, e.entry, {', '.join(map(mean, ('a', 'b', 'c', 'd0')))} from {book} e left join (select v.*, s.entry from v join {assigned} s using (row_id, part)) v on v.part=e.part and v.entry=e.entry group by e.part, e.entry)"""


#: for vectors of 64 components, four a part
ORACLE = f"""with k as (select vec_id, label, row_number() over (order by vec_id nulls last, embedding) - 1 as row_id, list_transform(embedding, lambda x: cast(floor(256*cast(x as double)) as bigint)) as q
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x)))=0),
v as (select vec_id, label, row_id, part, q[4*part+1] as a, q[4*part+2] as b, q[4*part+3] as c, q[4*part+4] as d0 from k cross join (select unnest(range(16)) as part)),
b0 as (select part, row_id as entry, a, b, c, d0 from v where row_id<64),
{_assign('s1', 'b0')}, {_mean('b1', 's1', 'b0')}, {_assign('s2', 'b1')}, {_mean('b2', 's2', 'b1')}, {_assign('s3', 'b2')},
r as (select row_id, vec_id, label, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(d) as bigint) as error from s3 group by all),
h as (select sha256(string_agg(a||','||b||','||c||','||d0, ',' order by part, entry)) as codebooks_sha256 from b2)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from r, h"""

"""Nearest vectors by cosine distance: exactly, as matrix products of blocks, and by an inverted file.

Both sides are packed into blocks inside their tasks. The exact way meets each block of rows with each block of queries, which
is a stated set. The inverted file cuts the rows into lists around centroids that are fitted on at most 2 x SAMPLE rows; every
row is in the list of its nearest centroid, a long list is many blocks, and a query probes the lists nearest to it. How many is
calibrated: the exact neighbours of at most 2 x CALIBRATED queries are found, and lists are added until the wanted share of
them is met. Null vectors, and those of another length than the first one, take no part; the distance to a zero vector is null
and such a row is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

ROWS, QUERIES = 2_048, 1_024
SENT_BYTES = 32 << 20
NEAR_BYTES = 16 << 20
SAMPLE, LIST_ROWS = 16_384, 500
CALIBRATED, RECALL = 100, 0.95
#: distances are rounded to six places before they are compared
ROUNDED = 1e-6
BLOCKS = "ids array<long>, vs binary"


def width(vectors: DataFrame) -> int:
    first = vectors.where("size(embedding) > 0").select(F.size("embedding").alias("n")).first()
    return first["n"] if first else 0


def matrix(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8").reshape(-1, n)


def units(vectors: DataFrame, n: int, size: int, centroids: np.ndarray | None = None, probes: int = 1) -> DataFrame:
    """(list, ids, vs): unit vectors in blocks of at most `size` rows; with centroids a block for each list, and a row in its `probes` nearest lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.array(b.column(0).to_pylist(), np.int64)
            x = np.array(b.column(1).to_pylist(), np.float64).reshape(len(ids), n)
            norm = np.sqrt((x * x).sum(axis=1))
            ids, x = ids[norm > 0], x[norm > 0] / norm[norm > 0, None]
            if centroids is None:
                parts = [(0, np.arange(len(ids)))] if len(ids) else []
            else:
                near = nearest_lists(x, centroids, probes)
                order = np.argsort(near, axis=None, kind="stable")  # a list's rows side by side, in their order
                lists, first = np.unique(near.ravel()[order], return_index=True)
                parts = list(zip(lists.tolist(), np.split(order // max(1, near.shape[1]), first[1:]), strict=True)) if len(lists) else []
            out = [(j, ids[rows[lo : lo + size]].tolist(), x[rows[lo : lo + size]].tobytes()) for j, rows in parts for lo in range(0, len(rows), size)]
            if out:
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.list_(pa.int64()), pa.binary()), strict=True)], ["list", "ids", "vs"])

    rows = vectors.where((F.size("embedding") == n) & F.forall("embedding", lambda v: v.isNotNull())).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, "list int, " + BLOCKS)


def nearest_lists(x: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """The lists of each row, a part of the rows at a time: what is held doesn't grow with rows times lists."""
    step = max(1, NEAR_BYTES // (8 * max(1, len(centroids))))
    near = [np.argsort(-(x[lo : lo + step] @ centroids.T), axis=1, kind="stable")[:, :probes].astype(np.int32) for lo in range(0, len(x), step)]
    return np.concatenate(near) if near else np.zeros((0, min(probes, len(centroids))), np.int32)


def compared(pairs: DataFrame, n: int, k: int) -> DataFrame:
    """(query, vec_id, distance) of pairs of blocks (ids, vs, q_ids, q_vs): the k nearest of each query, and what may be as near once distances are rounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, vs, q_ids, q_vs = (b.column(c)[i].as_py() for c in ("ids", "vs", "q_ids", "q_vs"))
                d = 1 - matrix(q_vs, n) @ matrix(vs, n).T
                edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.full((len(d), 1), np.inf)
                q, r = np.nonzero(d <= edge + 2 * ROUNDED)
                yield pa.record_batch([pa.array(np.array(q_ids, np.int64)[q]), pa.array(np.array(ids, np.int64)[r]), pa.array(d[q, r])], ["query", "vec_id", "distance"])

    return pairs.select("ids", "vs", "q_ids", "q_vs").mapInArrow(run, "query long, vec_id long, distance double")


def best(found: DataFrame, k: int, max_dist: float) -> DataFrame:
    """The k nearest of each query by rounded distance, then those beyond max_dist left out."""
    w = Window.partitionBy("query").orderBy("distance", "vec_id")
    out = found.withColumn("distance", F.round("distance", 6) + F.lit(0.0)).withColumn("rank", F.row_number().over(w))
    return out.where((F.col("rank") <= k)).where(F.col("distance") <= max_dist)


def sent(blocks: DataFrame, n_bytes: int) -> DataFrame:
    """Blocks of queries are broadcast while they are small, and else dealt out."""
    return F.broadcast(blocks) if n_bytes <= SENT_BYTES else blocks


def exact(vectors: DataFrame, queries: DataFrame, k: int, max_dist: float = 2.0) -> DataFrame:
    """(query, vec_id, distance, rank): every row is compared with every query, block by block."""
    n = width(vectors)
    n_queries = queries.count() if n else 0
    if not n_queries:
        return vectors.limit(0).select(F.col("vec_id").cast("long").alias("query"), F.col("vec_id").cast("long"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
    asked = stored(units(queries, n, QUERIES).withColumn("block", F.monotonically_increasing_id()))
    blocks = [r["block"] for r in asked.select("block").collect()]  # a number for each thousand queries
    asked = asked.select("block", F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"))
    rows = units(vectors, n, ROWS).withColumn("block", F.explode(F.array(*[F.lit(b) for b in blocks])))
    return best(compared(rows.join(sent(asked, n_queries * n * 8), "block"), n, k), k, max_dist)


def k_means(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids; x is in no order."""
    centroids = x[:k]
    for _ in range(rounds):
        of = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, x)
        norm = np.sqrt((sums * sums).sum(axis=1))
        centroids = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-300)[:, None], centroids)
    return centroids


def sampled(vectors: DataFrame, n: int, total: int, wanted: int) -> np.ndarray:
    """About `wanted` unit vectors, at most twice as many, chosen by the hash of their ids."""
    share = min(1.0, wanted / max(total, 1))
    chosen = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("vec_id")).limit(2 * wanted)
    parts = [matrix(bytes(r["vs"]), n) for r in units(chosen, n, ROWS).collect()]
    return np.concatenate(parts) if parts else np.zeros((0, n))


class InvertedFile:
    """The centroids, the stored lists, and how many of them a query probes."""

    def __init__(self, vectors: DataFrame, recall: float = RECALL, k: int = 10, queries: DataFrame | None = None):
        """`queries` (all rows, where none are named) are what the number of probes is calibrated on."""
        self.n, total = width(vectors), vectors.count()
        x = sampled(vectors, self.n, total, SAMPLE) if self.n else np.zeros((0, 0))
        self.centroids = k_means(x, max(1, min(len(x) // 8, total // LIST_ROWS))) if len(x) else x
        self.lists = stored(units(vectors, self.n, ROWS, self.centroids)) if len(x) else None
        self.probes = self._calibrated(vectors, queries or vectors, k, recall) if len(x) else 0

    def _calibrated(self, vectors: DataFrame, queries: DataFrame, k: int, recall: float) -> int:
        share = min(1.0, CALIBRATED / max(queries.count(), 1))
        some = queries.where(F.pmod(F.xxhash64("vec_id", F.lit(6)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * CALIBRATED)
        truth = exact(vectors, some, k + 1).where("query <> vec_id").select("query", "vec_id")
        at = truth.join(self.lists.select("list", F.explode("ids").alias("vec_id")), "vec_id").groupBy("query").agg(F.collect_list("list").alias("lists")).collect()  # k lists a query
        wanted = {r["query"]: r["lists"] for r in at}
        ranks = []
        for r in units(some, self.n, QUERIES).collect():
            for i, order in zip(r["ids"], nearest_lists(matrix(bytes(r["vs"]), self.n), self.centroids, len(self.centroids)), strict=True):
                place = {j: p for p, j in enumerate(order.tolist())}
                ranks += [place[j] for j in wanted.get(i, [])]
        ranks = np.sort(np.array(ranks))
        return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1 if len(ranks) else 1

    def search(self, queries: DataFrame, k: int, max_dist: float = 2.0) -> DataFrame:
        """(query, vec_id, distance, rank) of the rows in the lists that a query probes."""
        if self.lists is None:
            return exact(queries.limit(0), queries.limit(0), k)
        asked = units(queries, self.n, QUERIES, self.centroids, self.probes).select("list", F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"))
        return best(compared(self.lists.join(asked, "list"), self.n, k), k, max_dist)

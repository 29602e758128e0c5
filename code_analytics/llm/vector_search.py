"""Approximate nearest neighbours: a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample of SAMPLE rows: a node whose share of the rows is larger than a leaf should hold is
split by k-means into up to `branch` children. Every row then goes down to the leaf of its nearest centroids. A search keeps
a priority queue of nodes by the distance of their centroids, takes the nearest, and puts its children back or, at a leaf,
visits it. How many leaves are visited is calibrated: for a bounded set of queries the true neighbours are found by a scan of
the whole index, the leaves are visited in the order of the queue, and the visits are widened until the wanted share of true
neighbours lies in visited leaves. Where vectors have no structure that is most of the tree, so recall is kept and time is not.

Leaves below the same node are a bin. Leaves, bin by bin, are packed into parts of about as many rows each (many parts where
a leaf is large). Up to CHUNK_QUERIES queries meet a part in a cell: a task that holds these queries with the leaves they want
there and reads the part's rows leaf by leaf, keeping the nearest. Queries and rows are dealt to cells by one shuffle and are
never broadcast: a query comes once for each part it visits, which is many times what a plan expects from the table of queries.
Of equal vectors only the k + 1 smallest ids are in the index, since no answer needs more, and equal queries are asked once;
their answers are joined back with the copies of hot queries spread.

Distances are Euclidean in double precision on the original vectors, from differences; products only choose candidates, with
room for their rounding.

Vectors that are null, empty, of another length than that of the smallest vec_id, zero, or hold a null or non-finite
component take no part, and neither do rows without vec_id. Every row is a candidate of its own: of repeated rows each query
leaves out one, itself. Ties go to the smaller vec_id. With fewer than `k` candidates all are returned; an empty table or
one without queries gives an empty result. Columns beside vec_id and embedding are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kernels import stored, table
from .units import column
from .vectors import dimensions, joined_by_hot_keys, matrix

K = 10
BRANCH = 16
#: rows the tree is fitted on, at most twice as many, and of which a leaf must hold some
SAMPLE = 32_768
LEAST_SAMPLE = 8
LEAF_ROWS = 200
#: queries whose true neighbours are looked up, at most twice as many, and the share of these that must be found
CALIBRATED = 200
RECALL = 0.96
BLOCK_ROWS = 2_048
BLOCK_QUERIES = 1_024
#: parts that the rows are dealt out to: so many, of no fewer and no more rows than this
PARTS = 64
LEAST_PART, MOST_PART = 1_024, 262_144
#: queries a task holds at once, and those for which it looks into the tree at once and at least
CHUNK_QUERIES = 65_536
TREE_QUERIES, LEAST_ASKED = 256, 64


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and y by products; rounding may be off in the last places."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None], 0)


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Which of up to k centroids each row belongs to; the first centroids lie far apart."""
    picked = [0]
    near = _squares(x, x[:1])[:, 0]
    for _ in range(k - 1):
        far = int(np.argmax(near))
        if near[far] <= 0:
            break
        picked.append(far)
        near = np.minimum(near, _squares(x, x[far : far + 1])[:, 0])
    centroids = x[picked]
    for _ in range(rounds):
        of = _squares(x, centroids).argmin(axis=1)
        used = np.unique(of)
        centroids = np.stack([x[of == j].mean(axis=0) for j in used])
    return _squares(x, centroids).argmin(axis=1)


class Tree:
    """Centroids of all nodes, the children of each, and the leaves; leaves below one node share a bin and are told apart by their slot there."""

    def __init__(self, sample: np.ndarray, n_rows: int, leaf_rows: int = LEAF_ROWS, branch: int = BRANCH, least: int = LEAST_SAMPLE):
        few = max(least, leaf_rows * len(sample) / max(n_rows, 1))
        self.children: dict[int, list[int]] = {}
        centroids, todo = [sample.mean(axis=0)], [(0, sample)]
        while todo:
            node, x = todo.pop()
            if len(x) <= few:
                continue
            of = k_means(x, min(branch, max(2, round(len(x) / few))))
            parts = [x[of == j] for j in np.unique(of)]
            if len(parts) < 2:
                continue
            self.children[node] = list(range(len(centroids), len(centroids) + len(parts)))
            for child, part in zip(self.children[node], parts, strict=True):
                centroids.append(part.mean(axis=0))
                todo.append((child, part))
        self.centroids = np.stack(centroids)
        self.leaves = [n for n in range(len(centroids)) if n not in self.children]
        self.leaf_of = {n: i for i, n in enumerate(self.leaves)}
        above = {c: n for n, cs in self.children.items() for c in cs} or {0: 0}
        self.parents = np.array([above.get(n, 0) for n in range(len(centroids))])
        bin_of = {n: i for i, n in enumerate(sorted({above[n] for n in self.leaves}))}
        self.n_bins, slots = len(bin_of), {}
        self.bin = np.array([bin_of[above[n]] for n in self.leaves])
        self.slot = np.zeros(len(self.leaves), np.int64)
        for i, b in enumerate(self.bin.tolist()):
            self.slot[i] = slots.get(b, 0)
            slots[b] = slots.get(b, 0) + 1

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, down the nearest centroids."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            kids = self.children.get(node)
            if kids is None:
                out[rows] = self.leaf_of[node]
                continue
            of = _squares(x[rows], self.centroids[kids]).argmin(axis=1)
            todo.extend((kid, rows[of == j]) for j, kid in enumerate(kids))
        return out

    def best_bins_first(self, x: np.ndarray, n_leaves: int) -> Iterator[list[int]]:
        """For each row the first n_leaves leaves in the order of the queue."""
        far = _squares(x, self.centroids)
        for d in far:
            queue, found = [(d[0], 0)], []
            while queue and len(found) < n_leaves:
                _, node = heapq.heappop(queue)
                kids = self.children.get(node)
                if kids is None:
                    found.append(self.leaf_of[node])
                else:
                    for kid in kids:
                        heapq.heappush(queue, (d[kid], kid))
            yield found

    def visited(self, x: np.ndarray, n_leaves: int) -> np.ndarray:
        """(rows, leaves): whether a leaf is among the first n_leaves of a row.

        The queue takes nodes by the farthest node on their way, and below that one by the farthest of the rest.
        """
        far = _squares(x, self.centroids)
        far[:, 0] = 0  # the root comes first
        n_leaves = min(n_leaves, len(self.leaves))
        most = far.copy()
        for node, kids in self.children.items():  # parents come before their children
            most[:, kids] = np.maximum(far[:, kids], most[:, [node]])
        most = most[:, self.leaves]
        edge = np.partition(most, n_leaves - 1, axis=1)[:, [n_leaves - 1]]
        out = most < edge
        for i, missing in enumerate((n_leaves - out.sum(axis=1)).tolist()):
            level = np.flatnonzero(most[i] == edge[i])
            if len(level) > missing:
                level = level[np.lexsort(self._ways(far[i], level))[:missing]]
            out[i, level] = True
        return out

    def _ways(self, far: np.ndarray, leaves: np.ndarray) -> list[np.ndarray]:
        """For each leaf, its number and the farthest node from each level of its way on; the root comes last."""
        steps = [np.array(self.leaves)[leaves]]
        while steps[-1].any():
            steps.append(self.parents[steps[-1]])
        depth = np.sum([s > 0 for s in steps], axis=0)
        ways = np.full((len(steps), len(leaves)), -1.0)
        for up, nodes in enumerate(steps):
            level = depth - up
            there = np.flatnonzero(level >= 0)
            ways[level[there], there] = far[nodes[there]]
        return [leaves, *np.maximum.accumulate(ways[::-1], axis=0)]


def widened(leaf_ranks: np.ndarray, n_leaves: int, recall: float = RECALL) -> int:
    """The fewest visits, doubled and then cut back, by which `recall` of the true neighbours are met; leaf_ranks says at which visit (from 0) each is."""
    met = lambda visits: (leaf_ranks < visits).mean() >= recall
    visits = 1
    while visits < n_leaves and not met(visits):
        visits *= 2
    low, high = visits // 2, min(visits, n_leaves)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if met(mid) else (mid, high)
    return high


def usable(vectors: DataFrame, n: int) -> DataFrame:
    """vec_id and v, the bytes of its components, of the rows that take part; and two digests of v. Zeros of both signs are equal."""
    kind = "<f8" if dict(vectors.dtypes)["embedding"] == "array<double>" else "<f4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = matrix(column(b, "embedding"), n)
            there = ~column(b, "vec_id").is_null().to_numpy(zero_copy_only=False)[rows] & (x != 0).any(axis=1)
            rows, x = rows[there], (x[there] + 0.0).astype(kind)
            yield pa.record_batch([column(b, "vec_id").take(pa.array(rows)), pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "v"])

    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, v binary")
    return rows.select("vec_id", "v", F.xxhash64("v").alias("d1"), F.xxhash64("v", F.lit(1)).alias("d2"))


def held_vectors(raw: bytes, count: int, n: int) -> np.ndarray:
    """The rows in the precision in which they are held."""
    if not count:
        return np.zeros((0, n))
    return np.frombuffer(raw, "<f8" if len(raw) == 8 * count * n else "<f4").reshape(count, n)


def vectors_of(raw: bytes, count: int, n: int) -> np.ndarray:
    return held_vectors(raw, count, n).astype(np.float64)


def distances(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray, step: int = 16_384) -> np.ndarray:
    """Euclidean distances of pairs of rows, x[i] and y[j]."""
    out = np.empty(len(i))
    for lo in range(0, len(i), step):
        part = slice(lo, lo + step)
        out[part] = np.sqrt(((x[i[part]] - y[j[part]]) ** 2).sum(axis=1))
    return out


def nearest(queries: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the k nearest rows of each query and those that are as near as the last of them."""
    if not len(queries) or not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    d = _squares(queries, rows)
    if len(rows) > k:
        # products round; what they call a little farther than the k-th may be as near
        edge = np.partition(d, k - 1, axis=1)[:, k - 1]
        room = 1e-9 * ((queries * queries).sum(axis=1) + (rows * rows).sum(axis=1).max())
        q, r = np.nonzero(d <= (edge + room)[:, None])
    else:
        q, r = (a.reshape(-1) for a in np.indices(d.shape))
    return q, r, distances(queries, q, rows, r)


def least(df: DataFrame, n: int, keys: tuple[str, ...], *order: str | Column) -> DataFrame:
    """The first n rows of each key; Spark keeps n a task before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n)


def classes(rows: DataFrame, n_ids: int) -> DataFrame:
    """d1, d2, v, ids (the n_ids smallest) of equal vectors."""
    some = least(rows, n_ids, ("d1", "d2"), "vec_id")
    return some.groupBy("d1", "d2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def sampled(rows: DataFrame, total: int, wanted: int, n: int) -> np.ndarray:
    """About `wanted` different vectors, at most twice as many, chosen by the digest of id and vector."""
    share = min(1.0, wanted / max(total, 1))
    chosen = rows.where(F.pmod(F.xxhash64("vec_id", "d1", F.lit(2)), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").limit(2 * wanted).collect()
    return np.unique(vectors_of(b"".join(bytes(r["v"]) for r in chosen), len(chosen), n), axis=0)


def first_of_each(q: np.ndarray, k: int, *order: np.ndarray) -> np.ndarray:
    """Places of the first k of each q, by `order` (the last one counts most)."""
    by = np.lexsort((*order, q))
    return by[np.arange(len(q)) - np.searchsorted(q[by], q[by]) < k]


def calibrated(index: DataFrame, tree: Tree, some: np.ndarray, n: int, k: int, recall: float) -> int:
    """Visits by which `recall` of the k nearest classes of some queries, themselves left out, are met; one scan of the index."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK_ROWS):
                b = whole.slice(lo, BLOCK_ROWS)
                raw = column(b, "v").to_pylist()
                leaf = column(b, "leaf").to_numpy().astype(np.int64)
                q, r, d = nearest(some, vectors_of(b"".join(raw), len(raw), n), k + 1)
                q, leaf, d = (np.concatenate(p) for p in zip(kept, (q, leaf[r], d), strict=True))
                top = first_of_each(q, k + 1, d)
                kept = q[top], leaf[top], d[top]
        yield pa.record_batch([pa.array(a) for a in kept], ["q", "leaf", "d"])

    near = index.select("v", "leaf").mapInArrow(scan, "q long, leaf long, d double")
    found = least(near, k + 1, ("q",), "d", "leaf").where("d > 0").select("q", "leaf").collect()  # k rows a calibrated query
    wanted: dict[int, list[int]] = {}
    for r in found:
        wanted.setdefault(r["q"], []).append(r["leaf"])
    ranks = []
    for q, visits in enumerate(tree.best_bins_first(some, len(tree.leaves))):
        at = {leaf: i for i, leaf in enumerate(visits)}
        ranks += [at[leaf] for leaf in wanted.get(q, [])]
    return widened(np.array(ranks), len(tree.leaves), recall) if ranks else 1


class Parts:
    """The leaves, bin by bin, in parts of about as many rows: the first part of each leaf and how many it has to itself; the places of leaves, and those of a part."""

    def __init__(self, tree: Tree, sizes: np.ndarray):
        total = int(sizes.sum())
        wanted = max(min(PARTS, -(-total // LEAST_PART)), -(-total // MOST_PART), 1)
        most = max(1, -(-total // wanted))
        order = np.lexsort((tree.slot, tree.bin))
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.first, self.count = np.zeros(len(order), np.int64), np.ones(len(order), np.int64)
        part, held = 0, 0
        for leaf in order.tolist():
            size = int(sizes[leaf])
            if held and held + size > most:
                part, held = part + 1, 0
            self.first[leaf] = part
            if size > most:
                self.count[leaf] = -(-size // most)
                part += int(self.count[leaf])
            else:
                held += size
        self.n = int((self.first + self.count).max())
        self.low, self.high = np.full(self.n, len(order)), np.zeros(self.n, np.int64)
        for leaf in order.tolist():
            own = slice(self.first[leaf], self.first[leaf] + self.count[leaf])
            self.low[own] = np.minimum(self.low[own], self.place[leaf])
            self.high[own] = np.maximum(self.high[own], self.place[leaf] + 1)


#: a query (place -1) with a bit for each leaf of the part that it wants, or a row with its ids; cell is chunk * parts + part
CELLS = "cell int, place int, d1 long, d2 long, v binary, wanted binary, ids array<long>"


def asked(queries: DataFrame, tree: Tree, parts: Parts, n_chunks: int, visits: int, n: int) -> DataFrame:
    """As CELLS: each query for each part where it visits a leaf."""
    order = np.argsort(parts.place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, TREE_QUERIES):
                some = b.slice(lo, TREE_QUERIES)
                d1, d2, v = (column(some, c) for c in ("d1", "d2", "v"))
                visited = tree.visited(vectors_of(b"".join(v.to_pylist()), some.num_rows, n), visits)[:, order]
                chunk = d2.to_numpy() % n_chunks
                for part in range(parts.n):
                    wanted = visited[:, parts.low[part] : parts.high[part]]
                    there = np.flatnonzero(wanted.any(axis=1))
                    if len(there):
                        at, bits = pa.array(there), np.packbits(wanted[there], axis=1)
                        yield pa.record_batch(
                            [pa.array((chunk[there] * parts.n + part).astype(np.int32)), pa.array(np.full(len(there), -1, np.int32)), d1.take(at), d2.take(at), v.take(at), pa.array([w.tobytes() for w in bits], pa.binary()), pa.nulls(len(there), pa.list_(pa.int64()))],
                            ["cell", "place", "d1", "d2", "v", "wanted", "ids"],
                        )

    return queries.select("d1", "d2", "v").mapInArrow(run, CELLS)


def dealt(index: DataFrame, parts: Parts, n_chunks: int) -> DataFrame:
    """As CELLS: each row in its part, once for each chunk of the queries."""
    spark = index.sparkSession
    leaves = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(zip(parts.place, parts.first, parts.count, strict=True))], "leaf int, place int, first int, count int")
    part = F.col("first") + F.pmod("d2", F.col("count")).cast("int")
    rows = index.join(F.broadcast(leaves), "leaf").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    none = F.lit(None)
    return rows.select((F.col("chunk") * parts.n + part).alias("cell"), "place", none.cast("long").alias("d1"), none.cast("long").alias("d2"), "v", none.cast("binary").alias("wanted"), "ids")


class Cell:
    """The queries of a cell and the k nearest classes of each among the rows read so far."""

    def __init__(self, low: int, n_leaves: int, n: int, k: int):
        self.low, self.n_leaves, self.n, self.k = low, n_leaves, n, k
        self.asking: list[tuple[np.ndarray, np.ndarray, bytes, bytes]] = []
        self.x: np.ndarray | None = None
        self.sizes, self.ids, self.least, self.n_rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        self.n_found = 0

    def ask(self, b: pa.RecordBatch) -> None:
        self.asking.append((column(b, "d1").to_numpy(), column(b, "d2").to_numpy(), b"".join(column(b, "v").to_pylist()), b"".join(column(b, "wanted").to_pylist())))

    def _begin(self) -> None:
        self.d1, self.d2 = (np.concatenate([a[c] for a in self.asking]) for c in (0, 1))
        count = len(self.d1)
        self.x = held_vectors(b"".join(a[2] for a in self.asking), count, self.n)
        bits = np.frombuffer(b"".join(a[3] for a in self.asking), np.uint8).reshape(count, -1)
        self.wanted = np.unpackbits(bits, axis=1, count=self.n_leaves).astype(bool).T.copy()
        self.near = np.full(count, np.inf)  # the k-th distance so far
        self.asking = []

    def read(self, b: pa.RecordBatch) -> None:
        """Rows in the order of their leaves; without queries they are passed over."""
        if self.x is None and not self.asking:
            return
        if self.x is None:
            self._begin()
        ids, place = column(b, "ids"), column(b, "place").to_numpy()
        y = vectors_of(b"".join(column(b, "v").to_pylist()), b.num_rows, self.n)
        sizes, flat = ids.value_lengths().to_numpy().astype(np.int64), np.array(ids.flatten())
        self.sizes.append(sizes)
        self.ids.append(flat)
        self.least.append(flat[np.cumsum(sizes) - sizes])
        edges = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            mine = np.flatnonzero(self.wanted[place[lo] - self.low])
            for q in range(0, len(mine), BLOCK_QUERIES):
                for r in range(lo, hi, BLOCK_ROWS):
                    self._meet(mine[q : q + BLOCK_QUERIES], y[r : min(hi, r + BLOCK_ROWS)], self.n_rows + r)
        self.n_rows += b.num_rows

    def _meet(self, mine: np.ndarray, y: np.ndarray, at: int) -> None:
        x, edge = self.x[mine].astype(np.float64), self.near[mine] ** 2
        d = _squares(x, y)
        if len(y) > self.k and np.isinf(edge).any():
            edge = np.minimum(edge, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
        # products round; what they call a little farther than the k-th may be as near
        room = 1e-9 * ((x * x).sum(axis=1) + (y * y).sum(axis=1).max())
        q, r = np.nonzero(d <= (edge + room)[:, None])
        self.found.append((mine[q], at + r, distances(x, q, y, r)))
        self.n_found += len(q)
        if self.n_found > 2 * self.k * len(self.near) + BLOCK_ROWS:
            self._keep()

    def _keep(self) -> None:
        q, r, d = (np.concatenate(z) for z in zip(*self.found, strict=True))
        self.least = [np.concatenate(self.least)]
        top = first_of_each(q, self.k, self.least[0][r], d)
        q, r, d = q[top], r[top], d[top]
        self.found, self.n_found = [(q, r, d)], len(q)
        last = np.arange(len(q)) - np.searchsorted(q, q) == self.k - 1
        self.near[q[last]] = d[last]

    def answers(self) -> Iterator[pa.RecordBatch]:
        if self.x is None:
            return
        self._keep()
        sizes, ids = np.concatenate(self.sizes), np.concatenate(self.ids)
        at = np.append(0, np.cumsum(sizes))
        for lo in range(0, self.n_found, CHUNK_QUERIES):
            q, r, d = (z[lo : lo + CHUNK_QUERIES] for z in self.found[0])
            stops = np.append(0, np.cumsum(sizes[r]))
            own = np.repeat(at[r] - stops[:-1], sizes[r]) + np.arange(stops[-1])
            of_row = pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(ids[own]))
            yield pa.record_batch([pa.array(self.d1[q]), pa.array(self.d2[q]), of_row, pa.array(d)], ["d1", "d2", "ids", "score"])


def compared(cells: DataFrame, parts: Parts, n: int, k: int) -> DataFrame:
    """(d1, d2, ids, score): of each cell the k nearest classes of each query, among the leaves it visits. Cells come sorted by cell and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell = -1, None
        for b in batches:
            of, place = (column(b, c).to_numpy() for c in ("cell", "place"))
            kind = place < 0
            edges = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi > lo and of[lo] != now:
                    if cell:
                        yield from cell.answers()
                    now, part = of[lo], of[lo] % parts.n
                    cell = Cell(parts.low[part], parts.high[part] - parts.low[part], n, k)
                if hi > lo:
                    (cell.ask if kind[lo] else cell.read)(b.slice(lo, hi - lo))
        if cell:
            yield from cell.answers()

    return cells.mapInArrow(run, "d1 long, d2 long, ids array<long>, score double")


def neighbours(vectors: DataFrame, is_query: Column, k: int = K, recall: float = RECALL, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for each query row but itself.

    `is_query` is a condition on vec_id.
    """
    vectors = vectors.select("vec_id", "embedding")
    spark, n = vectors.sparkSession, dimensions(vectors.where("vec_id is not null"))
    queries = usable(vectors.where(is_query), n)
    n_queries = queries.count() if n else 0
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, total = usable(vectors, n), vectors.count()
    tree = Tree(sampled(rows, total, sample, n), total, leaf_rows)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = column(b, "v").to_pylist()
            leaf = tree.leaf(vectors_of(b"".join(raw), len(raw), n))
            yield pa.record_batch([column(b, "d2"), column(b, "v"), column(b, "ids"), pa.array(leaf.astype(np.int32))], ["d2", "v", "ids", "leaf"])

    # k + 1 ids of equal vectors: one of them may be the query itself
    index = stored(classes(rows, k + 1).select("d2", "v", "ids").mapInArrow(descend, "d2 long, v binary, ids array<long>, leaf int"))
    visits = calibrated(index, tree, sampled(queries, n_queries, CALIBRATED, n), n, k, recall)
    sizes = np.zeros(len(tree.leaves), np.int64)
    for r in index.groupBy("leaf").count().collect():  # fewer than the sample has rows
        sizes[r["leaf"]] = r["count"]
    questions = stored(queries.groupBy("d1", "d2").agg(F.first("v").alias("v"), F.count("*").alias("copies")))
    n_questions = questions.count()
    parts, n_chunks = Parts(tree, sizes), -(-n_questions // CHUNK_QUERIES)
    # a small table is one partition, in which one task would look into the tree for all queries
    spread = questions.repartition(min(PARTS, -(-n_questions // LEAST_ASKED)), "d1", "d2")
    both = asked(spread, tree, parts, n_chunks, visits, n).unionByName(dealt(index, parts, n_chunks))
    cells = both.repartitionById(n_chunks * parts.n, "cell").sortWithinPartitions("cell", "place")
    each = compared(cells, parts, n, k + 1).withColumn("least_id", F.get("ids", F.lit(0)))
    # the k + 1 nearest classes hold the k nearest rows, whoever asks
    best = least(each, k + 1, ("d1", "d2"), "score", "least_id").groupBy("d1", "d2").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    found = F.flatten(F.transform("found", lambda c: F.transform(c["ids"], lambda i: F.struct(c["score"].alias("score"), i.alias("vec_id")))))
    answers = stored(best.withColumn("found", F.slice(F.sort_array(found), 1, k + 1)).join(questions.select("d1", "d2", "copies"), ["d1", "d2"]).select(F.struct("d1", "d2").alias("q"), "found", "copies"))
    asking = queries.select(F.col("vec_id").alias("query_id"), F.struct("d1", "d2").alias("q"))
    out = joined_by_hot_keys(asking, answers, "q", n_queries, "copies")
    own = F.array_position(F.transform("found", lambda x: x["vec_id"]), F.col("query_id"))
    others = F.filter("found", lambda x, i: i + 1 != F.col("own"))
    out = out.withColumn("own", own).select("query_id", F.posexplode(F.slice(others, 1, k)).alias("rank", "f"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all embeddings for every hundredth."""
    return neighbours(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)

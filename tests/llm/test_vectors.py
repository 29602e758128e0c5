"""The operators on vectors and n-grams against brute force, with nulls, ties, repeated rows and hot copies."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from code_analytics.llm import grams, queries, resampling, vector_codes, vector_search
from code_analytics.llm.vectors import joined_by_hot_keys
from tests.conftest import SF

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label int, code string, v string"


# vector codes


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.integers(1, 4), st.integers(1, 6), st.randoms(use_true_random=False))
def test_orchard_is_exact(n_entries, width, spread, rng):
    """Small ranges make many ties and equal entries."""
    entries = np.array([[rng.randint(-spread, spread) for _ in range(width)] for _ in range(n_entries)], np.int64)
    x = np.array([[rng.randint(-2 * spread, 2 * spread) for _ in range(width)] for _ in range(50)], np.int64)
    best, near = vector_codes.Orchard(entries).search(x)
    every = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert best.tolist() == every.argmin(axis=1).tolist() and near.tolist() == every.min(axis=1).tolist()


def _codes(rows, n_parts, n_entries, rounds):
    """The contract in plain Python."""
    rows = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    if not rows:
        return []
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
    rows = [r for r in rows if len(r[1]) == len(rows[0][1])]
    whole = [[max(-(2**27), min(2**27, math.floor(256 * float(np.float32(x))))) for x in r[1]] for r in rows]
    whole = [w + [0] * (-len(w) % n_parts) for w in whole]
    size = len(whole[0]) // n_parts
    parts = [[tuple(w[p * size : p * size + size]) for p in range(n_parts)] for w in whole]
    books = [[w[p] for w in parts[:n_entries]] for p in range(n_parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda p, a: min(range(len(books[p])), key=lambda e: (far(a, books[p][e]), e))
    for _ in range(rounds):
        held = collections.defaultdict(list)
        for w in parts:
            for p in range(n_parts):
                held[p, place(p, w[p])].append(w[p])
        for (p, e), some in held.items():
            books[p][e] = tuple(sum(c) // len(some) for c in zip(*some, strict=True))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    codes = [[place(p, w[p]) for p in range(n_parts)] for w in parts]
    errors = [sum(far(w[p], books[p][c[p]]) for p in range(n_parts)) for w, c in zip(parts, codes, strict=True)]
    by_label = collections.Counter()
    for r, e in zip(rows, errors, strict=True):
        by_label[r[2]] += e
    return [(r[0], "".join(f"{x:02x}" for x in c), e, by_label[r[2]], sha) for r, c, e in zip(rows, codes, errors, strict=True)]


ODD = [(5, None, 1), (6, [], 1), (7, [1.0, None, 0.0, 2.0], 1), (8, [NAN, 1.0, 1.0, 1.0], 1), (9, [1.0, INF, 1.0, 1.0], None), (10, [1.0, 2.0], 2), (None, [0.5, -0.25, 3.0, 1e30], None), (1, [0.0, 0.0, 0.0, 0.0], None), (2, [0.1, 0.2, 0.3, 0.4], 3), (2, [0.1, 0.2, 0.3, 0.4], 3), (3, [-0.0, 0.0, 0.001, -0.001], None)]


@pytest.mark.parametrize("rows", [ODD, [], ODD[:5], [(i, [math.sin(i * j) for j in range(1, 11)], i % 3 or None) for i in range(80)] + [(100 + i, [0.5] * 10, 7) for i in range(60)]], ids=["odd", "empty", "none usable", "many"])
def test_codes_by_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS)
    for n_parts, n_entries in ((2, 3), (4, 64)):
        got = vector_codes.compressed(df, n_parts, n_entries).collect()
        key = lambda r: (r[0] is None, *map(str, r))
        assert sorted(map(tuple, got), key=key) == sorted(_codes(rows, n_parts, n_entries, 2), key=key)


def test_hot_keys(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(3000)], "key string, i int")
    sums = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("i").alias("s"))
    got = joined_by_hot_keys(rows, sums, "key", 3000, "n").collect()
    want = collections.Counter()
    for i in range(3000):
        want["hot" if i % 3 else f"k{i}"] += i
    assert sorted((r.i, r.key, r.s) for r in got) == [(i, k, want[k]) for i in range(3000) for k in ["hot" if i % 3 else f"k{i}"]]


# nearest neighbours


def _nearest(rows, k, every):
    """All queries of a table against all its rows."""
    rows = [r for r in rows if r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    first = min(rows, key=lambda r: r[0], default=None)
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if len(v) == len(first[1])] if first else []
    rows = [r for r in rows if r[1].any()]
    out = []
    for a, (i, v) in enumerate(rows):
        if i % every == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for b, (j, w) in enumerate(rows) if b != a)
            out += [(i, n + 1, j, d) for n, (d, j) in enumerate(near[:k])]
    return sorted(out)


def _clustered(n, n_hot, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, 8)) * 4
    rows = [(i, (centres[i % 20] + rng.normal(size=8)).astype(np.float32).tolist()) for i in range(n)]
    hot = rows[7][1]
    return rows + [(10_000 + i, hot) for i in range(n_hot)]


def test_neighbours_when_all_leaves_are_visited(spark):
    """A wanted recall of 1 on every row visits what is needed; hot copies, repeated rows and odd vectors included."""
    odd = [(500, None), (501, []), (502, [1.0] * 7), (503, [0.0] * 8), (504, [NAN] * 8), (505, [None] * 8), (506, [INF] * 8), (None, [1.0] * 8), (20, [2.0] * 8), (20, [2.0] * 8), (20, [2.5] * 8), (30, [-0.0] * 7 + [1.0]), (40, [0.0] * 7 + [1.0])]
    rows = _clustered(300, 150) + odd
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, ids string").repartition(3)
    got = vector_search.neighbours(df, F.col("vec_id") % 10 == 0, recall=1.1, leaf_rows=20)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == _nearest(rows, 10, 10)


@pytest.mark.parametrize("rows", [[], [(0, None)], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [2.0, 2.0])]], ids=["empty", "null", "alone", "pair", "no query"])
def test_neighbours_of_few(spark, rows):
    got = vector_search.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == _nearest(rows, 10, 100)


@pytest.mark.parametrize("kind", ["clusters", "table"])
def test_recall(spark, kind):
    rows = _clustered(2_000, 300) if kind == "clusters" else [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(set)
    for r in vector_search.neighbours(df, F.col("vec_id") % 50 == 0, leaf_rows=50).collect():
        got[r.query_id].add((r.vec_id, r.score))
    want = collections.defaultdict(set)
    for q, _, i, d in _nearest(rows, 10, 50):
        want[q].add((i, d))
    assert set(got) == set(want) and all(len(got[q]) == 10 for q in want)
    assert sum(len(got[q] & want[q]) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_visits():
    assert [vector_search.widened(np.array(x), 100, 0.5) for x in ([0, 0, 9], [5, 5, 9], [3, 99, 99])] == [1, 6, 100]
    rng = np.random.default_rng(1)
    tree = vector_search.Tree(rng.normal(size=(500, 4)), 5_000, 100)
    x = rng.normal(size=(20, 4))
    for order in tree.best_bins_first(x, len(tree.leaves)):
        assert sorted(order) == list(range(len(tree.leaves)))
    assert [next(iter(o)) for o in tree.best_bins_first(x, 1)] == [o[0] for o in tree.best_bins_first(x, 9)]
    assert len({(b, s) for b, s in zip(tree.bin.tolist(), tree.slot.tolist(), strict=True)}) == len(tree.leaves) and tree.slot.max() < vector_search.BRANCH


def test_queries_are_not_broadcast(spark, monkeypatch):
    """A query stands once for each part it visits; a plan expects the bytes of the small table of queries and would broadcast these."""
    plans, plain = [], vector_search.compared
    monkeypatch.setattr(vector_search, "compared", lambda pairs, *a: plans.append(pairs._jdf.queryExecution().executedPlan().toString()) or plain(pairs, *a))
    df = spark.createDataFrame(_clustered(300, 0), "vec_id long, embedding array<float>")
    assert vector_search.neighbours(df, F.col("vec_id") % 10 == 0, leaf_rows=20).count() == 300
    (plan,) = plans
    assert plan.count("BroadcastExchange") == 1  # of the leaves' parts
    below = plan[plan.index("BroadcastExchange") :]
    assert "MapInArrow" not in below


@pytest.mark.parametrize("n_chunks", [1, 4])
def test_neighbours_over_many_cells(spark, monkeypatch, n_chunks):
    """Leaves of several parts, parts of several leaves, and several chunks of queries."""
    monkeypatch.setattr(vector_search, "PARTS", 13)
    monkeypatch.setattr(vector_search, "LEAST_PART", 10)
    rows = _clustered(300, 150) + [(20, [2.0] * 8), (20, [2.0] * 8)]
    n_queries = sum(i % 10 == 0 for i, _ in rows)
    monkeypatch.setattr(vector_search, "CHUNK_QUERIES", -(-n_queries // n_chunks))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = vector_search.neighbours(df, F.col("vec_id") % 10 == 0, recall=1.1, leaf_rows=40)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == _nearest(rows, 10, 10)


def test_visited_leaves_are_those_of_the_queue():
    rng = np.random.default_rng(4)
    for rows, n_rows in ((1, 10), (300, 3_000), (2_000, 100_000)):
        sample = rng.normal(size=(rows, 6))
        tree = vector_search.Tree(sample, n_rows)
        x = np.concatenate([rng.normal(size=(15, 6)), sample[:3]])
        for n in {1, len(tree.leaves) // 3 or 1, len(tree.leaves)}:
            assert [set(np.flatnonzero(v)) for v in tree.visited(x, n)] == [set(o) for o in tree.best_bins_first(x, n)]


def test_parts_hold_about_as_many_rows(monkeypatch):
    monkeypatch.setattr(vector_search, "LEAST_PART", 10)
    tree = vector_search.Tree(np.random.default_rng(5).normal(size=(500, 4)), 5_000, 100)
    for sizes in (np.zeros(len(tree.leaves), np.int64), np.arange(len(tree.leaves)) ** 3, np.full(len(tree.leaves), 7)):
        sizes[3:5] = [0, 2_000]
        parts, most = vector_search.Parts(tree, sizes), -(-sizes.sum() // 64)
        held = np.zeros(parts.n)
        for leaf, size in enumerate(sizes.tolist()):
            held[parts.first[leaf] : parts.first[leaf] + parts.count[leaf]] += size / parts.count[leaf]
            for part in range(parts.first[leaf], parts.first[leaf] + parts.count[leaf]):
                assert parts.low[part] <= parts.place[leaf] < parts.high[part]
        assert held.sum() == pytest.approx(sizes.sum()) and held.max() <= most and parts.n <= 2 * 64 + 1
        assert (parts.high - parts.low).sum() <= len(tree.leaves) + parts.count.sum()


# resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _features(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def _resampled(docs, target, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    have, want = collections.Counter(), collections.Counter()
    features = [(d, *_features(t)) for d, t in docs]
    for _, _, f in features:
        have.update(map(bucket, f))
    for t in target:
        want.update(map(bucket, _features(t)[1]))
    s, t = sum(have.values()), sum(want.values())
    gain = [math.floor(1000 * math.log((want[b] + 1) * (s + 10000) / ((have[b] + 1) * (t + 10000)))) for b in range(10000)]
    out = []
    for d, n, f in features:
        weight = sum(gain[bucket(x)] for x in f)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    enough = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(enough[: percent * len(enough) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def _drawn(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_resampling_of_the_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert _drawn(queries.QUERIES["op12_resampling"](spark, SF)) == _resampled(docs, target)


@pytest.mark.parametrize("kind", ["odd", "empty", "no target"])
def test_resampling_odd(spark, kind):
    rng = random.Random(5)
    words = ["Ab", "c", "é7", "日本", "x" * 300, "y" * 40, "q" * 40 + "z", "0"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(60)] + [(1, None), (None, "a b " * 30), (None, None), (2, ""), (3, "---\n\t"), (4, "w" * 70_000 + " v"), (5, "one two-three\x00four" * 15_000), (5, "one two-three\x00four" * 15_000), (61, "a b c " * 20)]
    target = [] if kind == "no target" else ["ab c é7", None, "", "a b a b", "x" * 300 + " y"]
    docs = [] if kind == "empty" else docs
    df = spark.createDataFrame([(*d, "r", 1) for d in docs], "doc_id long, text string, rank string, weight int").repartition(3)
    got = resampling.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=50)
    assert _drawn(got) == _resampled(docs, target, 50)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=80) | st.binary(min_size=250, max_size=270), min_size=1, max_size=30))
def test_spans(parts):
    """Keys, checksums and the table against the libraries; the parts are doubled, so that every span has an equal one."""
    parts = parts + parts
    size = np.array([len(p) for p in parts])
    spans = grams.Spans(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size)
    assert spans.xxhash64().tolist() == [xxhash.xxh64_intdigest(p) for p in parts]
    assert spans.crc32(np.arange(len(parts))).tolist() == [zlib.crc32(p) for p in parts]
    table = grams.Table(spans, 100)
    assert [parts[o] for o in table.owner[table.slot].tolist()] == parts and len(table.owner) == len(set(parts))
    assert table.bucket.tolist() == [zlib.crc32(parts[o]) % 100 for o in table.owner.tolist()] and table.count.tolist() == [parts.count(parts[o]) for o in table.owner.tolist()]


def test_equal_keys_are_told_apart(monkeypatch):
    """With a key that is always the same, the bytes decide."""
    monkeypatch.setattr(grams.Spans, "xxhash64", lambda self: np.full(len(self.start), 7, np.uint64))
    parts = [b"ab", b"ac", b"ab", b"", b"x" * 300, b"x" * 299 + b"y", b"x" * 300]
    size = np.array([len(p) for p in parts])
    table = grams.Table(grams.Spans(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size), 10)
    assert [parts[o] for o in table.owner[table.slot].tolist()] == parts and len(table.owner) == 5

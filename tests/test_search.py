"""Indexes against the plain ways and against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from code_analytics.operators import diffs, findings, search, vectors

rng = random.Random(11)
DOCS = [(i, " ".join(rng.choices(["a", "b", "c", "d", "The", "x-y", "ünï"], k=rng.randrange(30)))) for i in range(60)] + [(100, None), (101, ""), (102, "a " * 500)]
ASKED = ["a b", "c", "d a b c", "the ünï", "absent a", "x y"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(q,) for q in ASKED], "query string")


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    out = search.positional_index(spark, str(tmp_path_factory.mktemp("positions")), "doc_id", 4)
    for part in range(3):  # segments come one after another
        out.append(search.postings(docs.where(F.col("doc_id") % 3 == part), "doc_id"))
    return out


def test_indexed_equals_plain(docs, queries, index):
    tokens = search.tokenize(docs, "doc_id")
    assert rows(search.fts_match_indexed(index, queries, "doc_id")) == rows(search.fts_match(tokens, queries, "doc_id"))
    assert rows(search.cover_density_indexed(index, queries, "doc_id")) == rows(search.cover_density(tokens, queries, "doc_id"))
    assert rows(search.headline(docs, queries, "doc_id", index=index)) == rows(search.headline(docs, queries, "doc_id"))


def test_only_queried_terms_are_read(spark, index, monkeypatch):
    monkeypatch.setattr(search, "MOST_PUSHED", 5)
    found = search.asked_postings(index, spark.createDataFrame([("a",)], "query string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(term,a)" in plan.replace(" ", "")
    assert {r.term for r in found.collect()} == {"a"}


def _covers(tokens, terms):
    spans = {(i, j) for i in range(len(tokens)) for j in range(i, len(tokens)) if set(terms) <= set(tokens[i : j + 1])}
    minimal = [s for s in spans if not any(o != s and o[0] >= s[0] and o[1] <= s[1] for o in spans)]
    return round(sum(0.1 / (1 + sum(t not in terms for t in tokens[i : j + 1])) for i, j in minimal), 6)


def test_covers_of_three_terms(spark):
    texts = [[rng.choice("abcx") for _ in range(rng.randrange(14))] for _ in range(40)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {r.doc_id: r["rank"] for r in search.cover_density(search.tokenize(df, "doc_id"), spark.createDataFrame([("a b c",)], "query string"), "doc_id").collect()}
    assert got == {i: _covers(t, ["a", "b", "c"]) for i, t in enumerate(texts) if {"a", "b", "c"} <= set(t)}


def test_covers_of_a_long_document(spark):
    """A million hits in one document: each two neighbours are a cover."""
    tokens = spark.range(1_000_000).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("pos"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("token"))
    r = search.cover_density(tokens, spark.createDataFrame([("a b",)], "query string"), "doc_id").first()
    assert abs(r["rank"] - 99_999.9) < 1e-4 and r.hits == 1_000_000


def test_matching_symbols(spark):
    names = ["Getter", "get_x", "ab", "aB1", "ünïcode", "x", "", "getget", "dot.name", "a%b"]
    symbols = spark.createDataFrame([("r", f"f{i % 3}", n) for i, n in enumerate(names * 2)], "repo string, file_path string, name string")
    asked = ["get", "AB", "x ge t", "ünï", "nothing", "a%b ab", "t.n", "tt", "zz"]
    want = {}
    for q in asked:
        for i, n in enumerate(names * 2):
            if any(len(t) >= 2 and t in n.lower() for t in q.lower().split()):
                want[q, "r", f"f{i % 3}"] = want.get((q, "r", f"f{i % 3}"), 0) + 1
    found = search.matching_symbols(symbols, spark.createDataFrame([(q,) for q in asked], "query string"))
    assert rows(found) == sorted(((*k, n) for k, n in want.items()), key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


# vectors


@pytest.mark.parametrize("sent_bytes", [vectors.SENT_BYTES, 0])
def test_exact_vectors(spark, monkeypatch, sent_bytes):
    monkeypatch.setattr(vectors, "SENT_BYTES", sent_bytes)
    monkeypatch.setattr(vectors, "QUERIES", 3)
    r = np.random.default_rng(4)
    data = [(i, r.normal(size=6).round(1).tolist()) for i in range(80)] + [(200 + i, [1.0] * 6) for i in range(30)] + [(300, None), (301, [0.0] * 6), (302, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (303, [1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = rows(vectors.exact(df, df.where("vec_id % 10 = 0"), 7, 1.2))
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in data if v and len(v) == 6 and None not in v and any(v)]
    want = []
    for i, v in good:
        if i % 10 == 0:
            near = sorted((round(1 - float(v @ w) / float(np.linalg.norm(v) * np.linalg.norm(w)), 6) + 0.0, j) for j, w in good)[:7]
            want += [(i, j, d, n + 1) for n, (d, j) in enumerate(near) if d <= 1.2]
    assert [(q, k) for q, _, _, k in got] == [(q, k) for q, _, _, k in sorted(want, key=str)]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, sorted(want, key=str), strict=True)) and sum(a[1] != b[1] for a, b in zip(got, sorted(want, key=str), strict=True)) <= 1


def test_inverted_file(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LIST_ROWS", 50)
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 16))
    data = [(i, (centres[i % 12] + 0.4 * r.normal(size=16)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(4)
    asked = df.where("vec_id % 50 = 0")
    index = vectors.InvertedFile(df, queries=asked)
    assert index.lists.select(F.explode("ids")).count() == 3000 and 1 <= index.probes < len(index.centroids)
    got, want = index.search(asked, 10), vectors.exact(df, asked, 10)
    assert got.join(want, ["query", "vec_id"]).count() >= 0.9 * want.count() and got.count() == want.count()


def test_inverted_file_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.InvertedFile(df).search(df, 5).count() == 0 and vectors.exact(df, df, 5).count() == 0


# ranges


def test_merged_ranges(spark):
    spans = [("k", a, a + b) for a, b in [(1, 3), (2, 0), (5, 0), (9, 1), (30, 200), (31, 2), (231, 0), (300, 0)]] + [("m", 2, 2)]
    got = rows(diffs.merged_ranges(spark.createDataFrame(spans, "k string, start int, stop int"), "k"))
    assert got == [("k", 1, 5), ("k", 30, 231), ("k", 300, 300), ("k", 9, 10), ("m", 2, 2)]


def test_diff_symbols_by_brute_force(spark):
    patch = lambda spans: "\n".join(f"@@ -1,1 +{a},{n} @@" for a, n in spans)
    hunks = [("r", p, f"f{rng.randrange(3)}", patch([(rng.randrange(400), rng.randrange(150)) for _ in range(3)])) for p in range(40)]
    symbols = [("r", f"f{i % 3}", f"s{i}", "function", a, a + rng.randrange(120)) for i in range(60) for a in [rng.randrange(500)]]
    want = {(r, p, f, n, k, a) for r, p, f, t in hunks for s in t.split("\n") for b, c in [map(int, s.split("+")[1].split(" ")[0].split(","))] for q, g, n, k, a, z in symbols if g == f and a <= b + max(c - 1, 0) and z >= b}
    got = diffs.diff_symbols(spark.createDataFrame(hunks, "repo string, pr_number int, file_path string, patch string"), spark.createDataFrame(symbols, "repo string, file_path string, name string, kind string, start_line int, end_line int"))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_a_file_of_many_hunks(spark):
    """A hundred thousand hunks and ten thousand symbols of one file: pairs meet in a bin, not all with all."""
    hunks = spark.range(100_000).select(F.lit("r").alias("repo"), F.col("id").alias("pr_number"), F.lit("f").alias("file_path"), F.concat(F.lit("@@ -1 +"), (F.col("id") * 7 % 1_000_000).cast("string"), F.lit(" @@")).alias("patch"))
    symbols = spark.range(10_000).select(F.lit("r").alias("repo"), F.lit("f").alias("file_path"), F.col("id").cast("string").alias("name"), F.lit("function").alias("kind"), (F.col("id") * 100).cast("int").alias("start_line"), (F.col("id") * 100 + 49).cast("int").alias("end_line"))
    assert diffs.diff_symbols(hunks, symbols).count() == sum(i * 7 % 1_000_000 % 100 < 50 for i in range(100_000))
    index = spark.createDataFrame([("r", "f", "python", 3, "")], "repo string, file_path string, language string, line_count int, content string")
    asked = spark.range(1000).select(F.lit(1).alias("run_id"), F.col("id").alias("seq"), F.lit("r").alias("repo"), F.lit("f").alias("file"), (F.col("id") + 5).cast("int").alias("line"), F.lit("d").alias("description"), F.lit("").alias("fix_sketch"))
    hit = {i * 7 % 1_000_000 for i in range(100_000)}
    got = {r.seq for r in findings.verify_findings(asked, index, hunks).where("reason is null").collect()}
    assert got == {i for i in range(1000) if i + 5 in hit}


def _sent(df):
    """How often a plan shuffles by keys."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_words_of_a_document_are_not_shuffled(spark):
    """Postings of rows of one document are one; the texts are shuffled, not the occurrences of words."""
    docs = spark.createDataFrame([(1, "a b a"), (1, "B, c"), (2, None), (3, ""), (None, "x x"), (4, "É é")], "doc_id long, text string")
    out = search.postings(docs, "doc_id")
    assert _sent(out) == 1 and "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.term, r.doc_id): r.gaps for r in out.collect()}
    assert got == {("a", 1): [0, 2], ("b", 1): [0, 1], ("c", 1): [1], ("x", None): [0, 1], ("é", 4): [0, 1]}


def test_asked_postings_are_shuffled_once(spark, index, docs):
    """Cover density unpacks the places inside a document's row; a headline's text is shuffled whole."""
    queries = spark.createDataFrame([("a b",), ("a",)], "query string")
    plan = search.cover_density_indexed(index, queries, "doc_id")
    assert _sent(plan) == 1 and "Window" not in plan._jdf.queryExecution().executedPlan().toString()
    # in a plan the root comes first: the words are made above the join
    plan = search.headline(docs, queries, "doc_id", index=index)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("array_remove(split(") < plan.index("Join Inner")


def test_ranks_are_divided_without_a_window_of_a_query(spark):
    ranked = spark.createDataFrame([("q", 1, 2.0), ("q", 2, 1.0), ("z", 1, 0.0), (None, 1, 4.0)], "query string, key int, rank double")
    out = search.normalise_ranks(ranked)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((str(r.query), r.key, r.norm) for r in out.collect()) == [("None", 1, 1.0), ("q", 1, 1.0), ("q", 2, 0.5), ("z", 1, 0.0)]


def test_hybrid_search_meets_candidates_only(spark, monkeypatch):
    """q11: a text's documents meet its queries as candidates, not all of them."""
    from code_analytics.plans import code_queries
    from tests.conftest import SF

    sizes = []
    plain = search.hybrid_search
    monkeypatch.setattr(search, "hybrid_search", lambda fts, *rest: sizes.append(fts.groupBy("query").count().agg(F.max("count")).first()[0]) or plain(fts, *rest))
    assert code_queries.q11_hybrid_search(spark, SF).count() and sizes and max(sizes) <= 3 * code_queries.HYBRID_LIMIT

"""The training-data operators against brute force on small tables, with nulls, ties, empty and long texts."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from code_analytics.llm import bpe, decontamination, kernels, line_dedup, lm_scoring, near_dups, packing, passage_dedup, quality_model, quality_rules, queries, sharding, suffix_dedup
from code_analytics.llm.kernels import sliced
from tests.conftest import SF
from tests.test_queries import rows as as_rows

WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"
ODD = [(None, None, None, None, 1, "a"), (1, "", None, "s", 0, "b"), (2, "x" * 200_000, "en", None, 3, "c"), (3, "Ein Text " * 20_000, "en", "s", 4, "d"), (3, "Ein Text " * 20_000, "en", "s", 4, "d"), (4, " \n\t\n", "en", "s", 4, "e")]
BIG = 2**63 - 1


def lowered(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="module", params=["odd", "empty"])
def odd(spark, request):
    return spark.createDataFrame(ODD if request.param == "odd" else [], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got) == sorted(want) and as_rows(got) == as_rows(want)


# packing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|", "|><|endoftext|><|endoftext|>\n"]) | st.text(st.sampled_from("ab '\n\t\x00srtveldm12½٣é中_!́\x85\x1c ") | st.characters(codec="utf-8"), max_size=25), min_size=1, max_size=5))
def test_ids_are_the_tokenizers(parts):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tok = Tokenizer.from_file(path)
    for _, data, at in sliced(iter([pa.record_batch([pa.array(parts)], ["text"])])):
        ids, upto = packing.encoder(path).encode(data, at)
        assert [ids[a:b].tolist() for a, b in zip(upto[:-1], upto[1:], strict=True)] == [t.ids for t in tok.encode_batch(parts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), max_size=6), st.integers(0, 30))
def test_closest_fill(counts, room):
    sums = {0}
    for x, n in counts.items():
        sums = {s + k * x for s in sums for k in range(n + 1) if s + k * x <= room}
    used = packing.closest(counts, room)
    assert sum(k * v for k, v in used.items()) == max(sums) and all(v <= counts[k] for k, v in used.items())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_places_every_piece(counts):
    seen = collections.Counter()
    for times, pattern in packing.plan(counts, 64):
        assert times > 0 and sum(k * v for k, v in pattern.items()) <= 64
        seen.update({k: v * times for k, v in pattern.items()})
    assert dict(seen) == counts


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = {d: [*e.ids, 0] for (d, _), e in zip(texts, tok.encode_batch([t or "" for _, t in texts], add_special_tokens=False), strict=True)}
    got = packing.op1_packing(spark, SF).toPandas()
    for r in got.itertuples():
        piece = np.array(want[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
    for key, begin in (("doc_id", "start"), ("sequence_id", "offset")):
        for _, g in got.sort_values(begin).groupby(key):
            assert g[begin].tolist() == [0, *np.cumsum(g.length)[:-1]] and (key == "doc_id" or g.length.sum() <= 1024)
    assert got.groupby("doc_id").length.sum().to_dict() == {d: len(x) for d, x in want.items()}


def test_packing_odd(odd):
    out = packing.packed(odd, packing.tokenizer_path()).toPandas()
    assert len(out) >= odd.count() and (out.groupby("sequence_id").length.sum() <= 1024).all()


# line dedup


def near_lines(rows):
    occ, first = [], {}
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            if w := tuple(lowered(line)):
                occ.append((BIG if d is None else d, i, w))
    for o, i, w in sorted(occ):
        first.setdefault(w, (o, i))
    near, shorter = {}, collections.defaultdict(list)

    def note(w, x):
        if first[x] < first[w]:
            near[w] = min(near.get(w, (BIG + 1, 0)), first[x])

    for w in first:
        if len(w) >= 8:
            for j in range(len(w)):
                shorter[j, w[:j] + w[j + 1 :]].append(w)
    for (_, v), group in shorter.items():
        for w in group:
            for x in group:
                note(w, x)
            if v in first:
                note(w, v)
                note(v, w)
    out = [(o, i, *first[w], 0) if (o, i) > first[w] else (o, i, *near[w], 1) for o, i, w in occ if (o, i) > first[w] or w in near]
    return sorted(out)


def test_line_dedup(spark):
    r = random.Random(8)
    pool = [[r.choice("abcd") for _ in range(r.choice([4, 5, 6, 7, 8, 9, 12]))] for _ in range(40)]

    def line():
        w = list(r.choice(pool))
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            j = r.randrange(len(w))
            w[j : j + r.choice([0, 1])] = r.choice([[], ["x"], ["y"]])
            w = w or ["e"]
        return r.choice([" ", "  "]).join(w)

    rows = [(i, "\n".join(line() for _ in range(r.randrange(6)))) for i in range(150)] + [(None, "\n".join(map(" ".join, pool[:3]))), (None, None), (900, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((x.ord, x.line, x.first_ord, x.first_line, x.edits) for x in line_dedup.removed_lines(df).collect())
    assert got == near_lines(rows) and any(x[4] for x in got)
    gone = {(o, i) for o, i, *_ in got}
    kept = {x.doc_id: x.text for x in line_dedup.without_repeats(df.where("doc_id is not null")).collect()}
    assert all(kept[d] == "\n".join(s for i, s in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows if d is not None)


def test_line_dedup_of_a_hot_template(spark, monkeypatch):
    """One line with one changing word in every document: one variant for all of them. Beyond the bound lists are shuffled."""
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    rows = [(i, f"this page was made by user u{i} for all of us\nown{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {(x.ord, x.line, x.first_ord, x.first_line, x.edits) for x in line_dedup.removed_lines(df).collect()}
    assert got == {(i, 0, 0, 0, 1) for i in range(1, 300)}
    assert line_dedup.removed_lines(df, near_words=12).count() == 0
    assert {x.text for x in line_dedup.without_repeats(df).collect()} == {rows[0][1], *(f"own{i}" for i in range(1, 300))}


def test_line_dedup_takes_short_lines(spark):
    rows = [(1, "one\n\ntwo words\nThree short Words"), (2, "ONE\n\nthree  short words\ntwo other"), (3, "two words\none more\none")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.ord, x.line, x.first_ord, x.first_line, x.edits) for x in line_dedup.removed_lines(df).collect())
    assert got == [(2, 0, 1, 0, 0), (2, 2, 1, 3, 0), (3, 0, 1, 2, 0), (3, 2, 1, 0, 0)]


def test_line_dedup_odd(odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = {(x.ord, x.line, x.first_ord, x.first_line, x.edits) for x in line_dedup.removed_lines(odd).collect()}
    assert got == set(near_lines(rows))
    assert sorted(map(tuple, line_dedup.without_repeats(odd).collect()), key=repr) == sorted(map(tuple, odd.collect()), key=repr)


def test_line_dedup_variants_of_one_short_digest(spark, monkeypatch):
    """The first digest of every variant is the same, the second tells them apart: no link is hidden by a false head."""
    inner = line_dedup.variants

    def clashing(batches, near_words):
        for b in inner(batches, near_words):
            yield b.set_column(0, "v1", pa.array(np.zeros(b.num_rows, np.int64)))

    monkeypatch.setattr(line_dedup, "variants", clashing)
    r = random.Random(21)
    base = [[r.choice("abcd") + r.choice("xyz") for _ in range(10)] for _ in range(12)]
    rows = []
    for i in range(60):
        w = list(r.choice(base))
        j = r.randrange(len(w))
        w[j : j + r.choice([0, 1])] = r.choice([[], [f"n{i}"]])
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((x.ord, x.line, x.first_ord, x.first_line, x.edits) for x in line_dedup.removed_lines(df).collect())
    assert got == near_lines(rows) and any(x[4] for x in got)


# near duplicates


def near_groups(rows):
    sets = []
    for _, t in rows:
        w = lowered(t)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else ()))
    distinct = list(dict.fromkeys(s for s in sets if s))
    parent = {s: s for s in distinct}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if 100 * len(a & b) >= 85 * len(a | b):
                parent[root(a)] = root(b)
    least = {}
    for (d, _), s in zip(rows, sets, strict=True):
        if s and d is not None:
            least[root(s)] = min(d, least.get(root(s), d))
    return sorted(((d, len(s), c := least.get(root(s)) if s else d, d == c) for (d, _), s in zip(rows, sets, strict=True)), key=repr)


@pytest.mark.parametrize("block", [512, 8, 2])
def test_near_dups(spark, monkeypatch, block):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    r = random.Random(4)
    base = [[r.choice("abcdefghijklmnop") + r.choice("xyz") for _ in range(r.choice([3, 5, 6, 9, 12, 40, 150]))] for _ in range(20)]
    rows = []
    for i in range(300):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            j = r.randrange(len(w))
            w[j : j + r.choice([0, 1])] = r.choice([[], [f"q{r.randrange(9)}"]])
            w = w or ["e"]
        rows.append((i, " ".join(w) if r.random() < 0.9 else "  ".join(w).upper()))
    rows += [(None, rows[0][1]), (None, None), (5000, None), (5001, ""), (5002, " \n"), *rows[:5]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = near_dups.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept")
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == near_groups(rows) and not all(x[3] for x in got)
    stay = {x.doc_id for x in near_dups.one_of_each(df).collect()}
    assert stay == {x[0] for x in got if x[3] and x[0] is not None} | ({None} if any(t is None for d, t in rows if d is None) else set())


def test_near_dups_odd(odd):
    """Rows equal in id and text stay together; a text without id, words or both is linked with nothing."""
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = near_dups.near_duplicates(odd).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == near_groups(rows)
    assert sorted(map(tuple, near_dups.one_of_each(odd).collect()), key=repr) == sorted(map(tuple, odd.collect()), key=repr)


def test_near_stage_at_four_fifths(spark):
    import corpus_pipeline

    sf = SF.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets, places = {}, collections.defaultdict(list)
    for d, t in docs.select("doc_id", "text").collect():
        w = lowered(t)
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else ())
        for s in sets[d]:
            places[s].append(d)
    parent = {d: d for d in sets}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    both = collections.Counter((a, b) for p in places.values() for i, b in enumerate(sorted(p)) for a in sorted(p)[:i])
    for (a, b), n in both.items():
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert {x.doc_id for x in corpus_pipeline.near(spark, docs, sf).collect()} == {d for d in sets if root(d) == d}


def test_sketch_fills_and_estimates():
    r = np.random.default_rng(0)
    for n in (1, 3, 40, 3000):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        assert near_dups.sketches([a], 256).all()
    a = np.unique(r.integers(0, 2**63, 1000).astype(np.uint64))
    s = near_dups.sketches([a[:900], a[100:]], 2000)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.05


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(300 + i, 301 + i) for i in range(60)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {x.node: x.root for x in near_dups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: root(v) for e in edges if e[0] != e[1] for v in e}


# the other operators


def test_lm_scoring(spark):
    out = lm_scoring.op5_lm_scoring(spark, SF).toPandas()
    assert len(out) == 200 and (out.log_prob <= 0).all() and out.remembered.dropna().between(0, 1).all()


def test_lm_scoring_learns_what_stands_around(spark):
    """Pairs of words that go together: the network beats the unigram model it starts from, and tells words of one shape apart."""
    r = random.Random(3)
    names = ["".join(r.choice("bcdfg") + r.choice("aeiou") for _ in range(4)) for _ in range(60)]
    docs = [(i, " ".join(f"{names[k]} {names[k + 1]}" for k in (2 * r.randrange(30) for _ in range(300)))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    vocab, net = lm_scoring.trained(df, 64, 16)
    counts = collections.Counter(w for _, t in docs for w in t.split())
    unigram = sum(n * np.log(n / sum(counts.values())) for n in counts.values()) / sum(counts.values())
    words = docs[0][1].split()
    swapped = [w for p in zip(words[1::2], words[::2], strict=True) for w in p]
    tries = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(swapped))], "doc_id long, text string")
    got = {x.doc_id: x.mean_log_prob for x in lm_scoring.scored(tries, vocab, net).collect()}
    assert got[0] > unigram + 0.5 and got[0] > got[1] + 0.5


def tiny_network():
    codes = np.sort(np.array([11, 22, 33], np.uint64))
    vocab, weight = lm_scoring.Vocabulary.of(codes, np.array([5, 3, 2]), np.array([4, 1]), np.array([3, 1]))
    net = lm_scoring.TokenNetwork(vocab, weight)
    r = np.random.default_rng(0)
    net.p = [r.normal(0, 0.5, x.shape) for x in net.p]
    return vocab, net


def test_lm_scoring_is_a_distribution_and_equals_brute_force(monkeypatch):
    monkeypatch.setattr(lm_scoring, "CLASSES", 3)
    vocab, net = tiny_network()
    assert len(vocab.first) > 2 and (np.diff(vocab.first) > 1).any()
    embed, scale, bias, w1, b1, w2, b2 = net.p
    tokens, upto = np.array([1, 0, 2, 3, 1, 2, 2, 4]), np.array([0, 4, 4, 7, 8])
    got, k = net.log_probs(vocab, tokens, upto), 0
    soft = lambda z: np.exp(z) / np.exp(z).sum()
    for a, b in zip(upto[:-1], upto[1:], strict=True):
        for i in range(a, b):
            around = [tokens[i + o] if a <= i + o < b else vocab.edge for o in lm_scoring.OFFSETS]
            h = np.tanh(bias[0] + sum(scale[j] * embed[t] for j, t in enumerate(around)))
            p = np.concatenate([c * soft(w2[lo:hi] @ h + b2[lo:hi, 0]) for c, lo, hi in zip(soft(w1 @ h + b1[:, 0]), vocab.first[:-1], vocab.first[1:], strict=True)])
            assert abs(p.sum() - 1) < 1e-9 and abs(np.log(p[tokens[i]]) - vocab.log_types[tokens[i]] - got[k]) < 1e-6
            k += 1


def test_lm_scoring_gradients(monkeypatch):
    monkeypatch.setattr(lm_scoring, "CLASSES", 3)
    v, net = tiny_network()
    tokens, upto = np.array([1, 0, 2, 3, 1, 2, 2, 4]), np.array([0, 4, 4, 7, 8])
    grads = [np.zeros_like(x) for x in net.p]
    before = net.log_probs(v, tokens, upto, grads).sum()
    for p, g in zip(net.p, grads, strict=True):
        for i in np.ndindex(p.shape):
            p[i] += 1e-6
            assert abs((net.log_probs(v, tokens, upto).sum() - before) / 1e-6 - g[i]) < 1e-3
            p[i] -= 1e-6


@pytest.mark.parametrize("bits", [0, 3])
def test_lm_scoring_memory_equals_brute_force(spark, monkeypatch, bits):
    """The counts of windows over the other texts, added up over groups and slices."""
    r = random.Random(11)
    rows = [(i, " ".join(r.choice("abcd") for _ in range(r.randrange(40)))) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(None, "a b c d a b c d"), (None, "a b c d a b c d"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(lm_scoring, "GROUP_BYTES", 200)
    vocab, net = lm_scoring.trained(df, 4, 4)
    got = sorted((x.n_words, x.memory_log_prob, x.log_prob, -1 if x.remembered is None else x.remembered) for x in lm_scoring.scored(df, vocab, net, bits).collect())
    found = []
    for x in lm_scoring.network_scores(df, vocab, net, bits).collect():
        found.append((x.n_words, x.log_prob, np.frombuffer(bytes(x.windows), lm_scoring.WINDOWS)))
    every, pairs = collections.Counter(), collections.Counter()
    for _, _, w in found:
        every.update(w["window"].tolist())
        pairs.update(zip(w["window"].tolist(), w["word"].tolist(), strict=True))
    want = []
    for n, lp, w in found:
        own, own_pairs = collections.Counter(w["window"].tolist()), collections.Counter(zip(w["window"].tolist(), w["word"].tolist(), strict=True))
        total, hits = lp, 0
        for c, x, p in zip(w["window"].tolist(), w["word"].tolist(), w["lp"].astype(float).tolist(), strict=True):
            same = pairs[c, x] - own_pairs[c, x]
            total += np.log((same + np.exp(p)) / (every[c] - own[c] + 1)) - p
            hits += same > 0
        want.append((n, total, lp, hits / len(w) if len(w) else -1))
    assert len(got) == len(rows) and np.allclose(np.array(got), np.array(sorted(want))) and any(x[3] > 0 for x in got)


def test_lm_scoring_odd(odd):
    out = lm_scoring.scored(odd, *lm_scoring.trained(odd)).collect()
    assert len(out) == odd.count() and all(x.mean_log_prob is None for x in out if x.n_words == 0)


def test_rows_without_id_of_one_short_hash(spark):
    """Two texts that a hash of 32 bits takes for one: neither goes for the other, and each loses its own lines."""
    texts = spark.range(600_000).select(F.concat_ws(" ", *[F.concat(F.lit(c), (F.col("id") * (k + 3) % 1_000_003).cast("string")) for k, c in enumerate("abcdefg")]).alias("text"))
    pair = texts.groupBy(F.hash(F.lit(1), "text").alias("h")).agg(F.collect_list("text").alias("t")).where("size(t) = 2").orderBy("h").first()
    a, b = pair.t
    again = "a line that stands in both of the long ones here"
    rows = [(None, a), (None, b), (1, b), (2, again)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collections.Counter(tuple(r) for r in near_dups.one_of_each(df).collect()) == collections.Counter([(None, a), (1, b), (2, again)])
    df = spark.createDataFrame([(None, f"{a}\n{again}"), (None, b), (1, again)], "doc_id long, text string")
    assert sorted(r.text for r in line_dedup.without_repeats(df).collect()) == sorted([a, b, again])


def test_small_groups_follow_their_language(spark):
    """Fences of groups of 2, 200 and 20,000 documents between those of their own and of their language."""
    rows = [("en", "s", "lines", 0, n) for n in (2,)] + [("en", "m", "lines", 0, 200), ("en", "l", "lines", 0, 20_000), ("de", "s", "lines", -5, 20_000)]
    sketch = spark.createDataFrame(rows, "lang string, source string, rule string, bin int, n long")
    got = {(r.lang, r.source): r.fence_lines for r in quality_rules.fences(sketch).collect()}
    assert got["en", "s"] == pytest.approx(got["en", "l"], rel=0.02) and got["de", "s"] < got["en", "l"]
    none = {(r.lang, r.source): r.fence_lines for r in quality_rules.fences(sketch, 0).collect()}
    assert none["en", "l"] == none["en", "m"] == pytest.approx(1.1**0.5 + 8 * 0.05)


def test_passages(spark):
    unit = "One two three four five six seven eight."
    df = spark.createDataFrame([(1, unit + " Tail.\nx"), (2, "pre é here. " + unit.replace(" ", "  ") + " after"), (None, unit), (None, None), (3, "")], "doc_id long, text string")
    got = {(x.doc_id, x.text) for x in passage_dedup.without_repeats(df).collect()}
    assert got == {(1, unit + " Tail.\nx"), (2, "pre é here.  after"), (None, ""), (3, "")}


def test_passages_of_short_sentences(spark):
    """A passage of short sentences in the middle of other lines goes whole, but for what its edges share with other words."""
    passage = "We went on. It was late. No one came. He slept. The dog did too. All was still. Then it rained."
    df = spark.createDataFrame([(1, f"First of all this is a line. {passage} And so it ended here."), (2, f"Another beginning stands here! {passage} But not the same end.\n{passage}")], "doc_id long, text string")
    assert {(x.doc_id, x.text) for x in passage_dedup.without_repeats(df).collect()} == {(1, f"First of all this is a line. {passage} And so it ended here."), (2, "Another beginning stands here!  But not the same end.\n")}
    runs = {(x.ord, x.start, x.length, x.first_ord) for x in passage_dedup.removed_runs(df).collect()}
    assert runs == {(2, 31, len(passage), 1), (2, 31 + len(passage) + 23, len(passage), 1)}


def test_passages_odd(odd):
    out = passage_dedup.without_repeats(odd).collect()
    assert len(out) == odd.count() and all(len(x.text) <= 200_000 for x in out)


def qda_scores(x, y, train):
    """Brute force: densities by inverse and determinant."""
    stats = {c: (m := (y == c) & train).sum() and (m.sum(), x[m].mean(axis=0), np.cov(x[m].T, bias=True)) for c in (0, 1)}
    total = stats[0][0] + stats[1][0]
    pooled = np.diag((stats[0][0] * np.diag(stats[0][2]) + stats[1][0] * np.diag(stats[1][2])) / total)
    log = {}
    for c, (n, mean, cov) in stats.items():
        s = (1 - quality_model.SHRINK) * cov + quality_model.SHRINK * pooled + quality_model.RIDGE * np.eye(len(mean))
        z = x - mean
        log[c] = np.log(n / total) - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z) - 0.5 * np.linalg.slogdet(s)[1]
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def test_quality_model_equals_brute_force(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = docs.select("doc_id", "text").toPandas().merge(labels.toPandas()[["doc_id", "quality"]], how="left", on="doc_id").sort_values("doc_id")
    data = [(t or "").encode() for t in rows.text]
    x = quality_model.statistics(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    y = rows.quality.fillna(-1).to_numpy()
    train = np.array([zlib.crc32(str(d).encode()) % 4 != 2 for d in rows.doc_id])
    got = quality_model.scored(docs, labels).toPandas().sort_values("doc_id")
    assert np.allclose(got.score, qda_scores(x, y, train), atol=1e-6) and (got.held_out.to_numpy() == ~train).all()
    assert (got.predicted == (got.score >= 0.7)).all()


def test_quality_model_held_out(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_model.op7_quality_model(spark, sf).where("held_out").join(labels, "doc_id").toPandas()
    assert len(out) > 50 and (out.predicted == out.quality).mean() > 0.9


def test_quality_model_odd(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {x.score for x in quality_model.scored(odd, none).collect()} <= {0.5}
    some = spark.createDataFrame([(i, i % 2) for i in range(1, 5)] + [(2, None), (None, 1)], "doc_id long, quality int")
    assert all(0 <= x.score <= 1 for x in quality_model.scored(odd, some).collect())


def test_sharding(spark, texts):
    out = sharding.op8_sharding(spark, SF).toPandas()
    assert {r.doc_id: (r.size, r.text_crc32) for r in out.itertuples()} == {d: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in texts}
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    sums = out.groupby("shard")["size"].sum()
    assert len(sums) == 24 and sums.max() - sums.min() <= out["size"].max()


def test_sharding_edits_its_map(spark):
    """Version 2 moves slots only out of shards beyond the mean; adding a shard moves slots only into it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = sharding.slot_sizes(docs.select((F.octet_length("text") + 8).alias("size"), sharding.slot_of("doc_id", "text").alias("virtual_slot")))
    bytes_ = {x.virtual_slot: x.slot_bytes for x in sizes.collect()}
    first = sharding.first_map(spark, 4)
    second = sharding.rebalanced(first, sizes, 4)
    one, two = ({x.virtual_slot: x.shard for x in m.collect()} for m in (first, second))
    load = lambda m: [sum(bytes_.get(k, 0) for k, v in m.items() if v == n) for n in range(5)]
    mean = sum(bytes_.values()) / 4
    assert set(one) == set(two) == set(range(sharding.N_SLOTS)) and {x.version for x in second.collect()} == {2}
    assert all(load(one)[one[k]] > mean for k in two if one[k] != two[k]) and max(load(two)[:4]) - min(load(two)[:4]) <= max(bytes_.values())
    grown = {x.virtual_slot: x for x in sharding.add_shard(second, sizes, 4).collect()}
    moved = [k for k in two if k in grown and grown[k].shard != two[k]]
    assert moved and all(grown[k].shard == 4 for k in moved) and {x.version for x in grown.values()} == {3}


def test_sharding_odd(odd, monkeypatch):
    for rows, most in ((sharding.GROUP_ROWS, sharding.BROADCAST_ROWS), (1, 0)):
        monkeypatch.setattr(sharding, "N_SLOTS", 4096 if rows > 1 else 2)
        monkeypatch.setattr(sharding, "GROUP_ROWS", rows)
        monkeypatch.setattr(sharding, "BROADCAST_ROWS", most)
        out = sharding.sharded(odd, 3, sharding.N_SLOTS).toPandas()
        assert len(out) == odd.count() and all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))


def counted(w):
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)])


def test_decontamination(spark):
    r = random.Random(2)
    token = lambda tail: r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice(tail)
    items = [(i, " ".join(token("xyz") for _ in range(r.choice([3, 5, 8, 20, 30])))) for i in range(20)]
    docs = []
    for i in range(120):
        w = [token("xyzw") for _ in range(r.randrange(60))]
        for _ in range(r.randrange(3)):
            it = lowered(r.choice(items)[1])
            for _ in range(r.choice([0, 0, 1, 2])):
                j = r.randrange(len(it))
                it[j : j + r.choice([0, 1])] = r.choice([[], ["QQ"]])
                it = it or ["e"]
            j = r.randrange(len(w) + 1)
            w[j:j] = it
        docs.append((i, " ".join(w)))
    docs += [(None, items[4][1]), (500, None), (501, "")]
    want = {}
    for d, t in docs:
        w = lowered(t)
        for k, item in items:
            iw = lowered(item)
            s = counted(iw)
            for j in range(max(1, len(w) - len(iw) + 1)) if w else ():
                x = w[j : j + len(iw)]
                n = sum((counted(x) & s).values())
                same = n / (sum(counted(x).values()) + sum(s.values()) - n)
                if same >= 0.8 and (len(iw) >= 5 or x == iw):
                    want[d, k] = max(want.get((d, k), 0), round(same, 9))
    docs_df, items_df = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (90, None), (91, "")], "item_id long, text string")
    assert {(x.doc_id, x.item_id): round(x.similarity, 9) for x in decontamination.leaks(docs_df.repartition(3), items_df).collect()} == want
    assert {x.doc_id for x in decontamination.clean(docs_df, items_df).collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontamination.clean(docs_df, items_df.limit(0)).count() == len(docs)


@pytest.mark.parametrize("items", [[], [(None, None), (1, ""), (2, "ein text ein TEXT ein text"), (2, "ein text ein TEXT ein text"), (3, "x" * 200_000), (4, "of none")]])
def test_decontamination_odd(spark, odd, items):
    """Documents of one repeated pair of words and of one very long word, against items of both, of nothing and without id."""
    df = spark.createDataFrame(items, "item_id long, text string")
    held = odd.count() > 0 and len(items) > 0
    got = {(x.doc_id, x.item_id): round(x.similarity, 9) for x in decontamination.leaks(odd, df).collect()}
    assert got == ({(2, 3): 1.0, (3, 2): 1.0} if held else {})
    want = [tuple(r) for r in odd.collect() if not (held and r.doc_id in (2, 3))]
    assert sorted(map(tuple, decontamination.clean(odd, df).collect()), key=repr) == sorted(want, key=repr)


def test_decontamination_of_long_texts():
    """A megabyte of one word against items of one word: windows with the same shingles are looked at once."""
    import resource

    index = decontamination.Index([1, 2, 3], ["word " * 40, "word " * 7 + "other", "word word"])
    text = ("word " * 200_000).encode()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = index.matches(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert [(k, s, n, round(same, 6)) for _, k, s, n, same in found] == [(0, 0, 40, 1.0), (2, 0, 2, 1.0)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400 << 10


def test_decontamination_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PART_ITEMS", 3)
    r = random.Random(9)
    items = [(i, " ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(12))) for i in range(10)]
    docs = [(i, f"x {items[i % 10][1]} y" if i % 3 else "none of these words at all") for i in range(30)]
    docs_df, items_df = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sum(1 for _ in decontamination.parts(items_df)) == 4
    assert {(x.doc_id, x.item_id) for x in decontamination.leaks(docs_df, items_df).collect()} == {(i, i % 10) for i in range(30) if i % 3}
    assert {x.doc_id for x in decontamination.clean(docs_df, items_df).collect()} == {i for i in range(30) if not i % 3}


def test_decontamination_in_any_order(spark):
    r = random.Random(6)
    token = lambda: r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("xyz")
    items = [(i, " ".join(token() for _ in range(n))) for i, n in enumerate([60, 70, 100, 100, 101])]
    docs = []
    for i in range(60):
        w = lowered(r.choice(items)[1])
        cuts = [0, *sorted(r.sample(range(1, len(w)), r.choice([1, 1, 2]))), len(w)]
        parts = [w[a:b] for a, b in zip(cuts, cuts[1:])]
        parts = r.choice([parts[::-1], parts[1:] + parts[:1]])
        docs.append((i, " ".join([token() for _ in range(r.choice([0, 70]))] + sum(parts, []) + [token() for _ in range(r.choice([0, 70]))])))
    half = lowered(items[2][1])
    docs.append((99, " ".join([token() for _ in range(150)] + half[50:] + half[:50] + [token() for _ in range(150)])))
    want = {}
    for d, t in docs:
        w = lowered(t)
        for k, item in items:
            s = counted(iw := lowered(item))
            for j in range(max(1, len(w) - len(iw) + 1)):
                x = counted(w[j : j + len(iw)])
                n = sum((x & s).values())
                if (same := n / (sum(x.values()) + sum(s.values()) - n)) >= 0.8:
                    want[d, k] = max(want.get((d, k), 0), round(same, 9))
    docs_df, items_df = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert (99, 2) in want and len(want) > 30
    assert {(x.doc_id, x.item_id): round(x.similarity, 9) for x in decontamination.leaks(docs_df.repartition(3), items_df).collect()} == want
    assert {x.doc_id for x in decontamination.clean(docs_df, items_df).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def removed_bytes(rows):
    best, out = {}, []
    for d, t in rows:
        b, o = (t or "").encode(), BIG if d is None else d
        for p in range(len(b) - 49):
            best[b[p : p + 50]] = min(best.get(b[p : p + 50], o), o)
    for d, t in rows:
        b, o = (t or "").encode(), BIG if d is None else d
        mark = [False] * len(b)
        for p in range(len(b) - 49):
            if best[b[p : p + 50]] < o:
                mark[p : p + 50] = [True] * 50
        spans = sum(m and not (i and mark[i - 1]) for i, m in enumerate(mark))
        out.append((d, len(b), sum(mark), spans, hashlib.sha256(bytes(x for x, m in zip(b, mark, strict=True) if not m)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batch", [10_000, 7])
@pytest.mark.parametrize("letters", ["abcdefgh é", "ab"])
def test_suffix_dedup(spark, letters, batch, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 60 * batch)
    r = random.Random(5)
    pool = ["".join(r.choice(letters) for _ in range(r.choice([30, 49, 50, 51, 60, 90, 200]))) for _ in range(12)] + ["a" * 70, "aaaa" * 40, "ab" * 50]
    text = lambda: "".join(r.choice(pool) if r.random() < 0.5 else "".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(r.randrange(7)))
    rows = [(None if r.random() < 0.03 else r.randrange(120), None if r.random() < 0.05 else text()) for _ in range(120)]
    rows += rows[:10]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = suffix_dedup.repeated_strings(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).drop("spans").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(map(tuple, got), key=repr) == removed_bytes(rows)


def test_suffix_dedup_odd(odd):
    got = suffix_dedup.repeated_strings(odd).drop("spans").collect()
    assert sorted(map(tuple, got), key=repr) == removed_bytes([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])


def test_suffix_dedup_over_steps(spark, monkeypatch):
    """Texts longer than a step and than a group, with passages that cross the steps at other places in each text."""
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 1 << 17)
    r = random.Random(12)
    noise = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    shared = [noise(n) for n in (60, 500, 30_000)]
    rows = []
    for d in range(4):
        parts, size = [], 0
        while size < suffix_dedup.STEP + 70_000:
            parts += [noise(r.randrange(100, 30_000)), r.choice(shared)]
            size += len(parts[-1]) + len(parts[-2])
        rows.append((d, "".join(parts)))
    rows.append((9, rows[2][1]))
    got = suffix_dedup.repeated_strings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).drop("spans").collect()
    assert sorted(map(tuple, got), key=repr) == removed_bytes(rows)


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the base rules."""
    w, seen, again = WORD.findall(text or ""), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), again, len(covered)


@pytest.mark.parametrize("most", [quality_rules.BROADCAST_ROWS, 0])
def test_quality_rules_odd(odd, monkeypatch, most):
    """The counts of odd rows by brute force; what fails the base rules goes, and beyond the broadcast bound as well."""
    monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", most)
    rows = [tuple(r) for r in odd.collect()]
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    counts = quality_rules.measured(odd, "doc_id", "lang", "source")
    assert sorted(map(tuple, counts.select(*names).collect()), key=repr) == sorted(((r[0], *base_counts(r[1])) for r in rows), key=repr)
    fine = lambda n: n[0] >= 20 and 100 * n[4] <= 30 * n[0]
    out = quality_rules.filtered(odd)
    assert out.columns == odd.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted((r for r in rows if fine(base_counts(r[1]))), key=repr)


@pytest.mark.parametrize("percent", [0, 11, 20, 40])
def test_quality_fences_hold_with_junk(spark, percent):
    """The share of junk in a group moves its fences by little, and all the junk goes."""
    r = random.Random(percent)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9)))
    rows = []
    for i in range(400):
        w = [word() for _ in range(80)]
        if i < 4 * percent:
            for j in r.sample(range(80), 40):
                w[j] = r.choice(["##$%", "&&|", "<*>#", "%%%%%"])
        rows.append((i, " ".join(w), "en", "hot"))
    counts = quality_rules.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "doc_id", "lang", "source")
    out = quality_rules.judged(counts, quality_rules.fences(quality_rules.sketches(counts))).collect()
    assert {x.doc_id for x in out if not x.kept} == set(range(4 * percent))


def test_quality_rules_keep_clean(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_rules.op3_quality_rules(spark, sf).where("not base_failed").join(labels, "doc_id").toPandas()
    assert out[out.quality == 1].kept.mean() > 0.98 and out[out.quality == 0].kept.mean() < 0.2


def test_pipeline_stages(spark, odd):
    import corpus_pipeline

    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd.columns
    docs = odd
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, SF)
    assert docs.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_pipeline(spark, texts):
    """The stages one after the other are run(), and the tables between them are deleted."""
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = kernels.stored(stage(spark, docs, SF))
    assert set(out.doc_id) == {x.doc_id for x in docs.select("doc_id").collect()} and 0 < out.doc_id.nunique() < len(texts)
    tokens = packing.pieces(docs, packing.tokenizer_path()).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, out[key].to_numpy().tolist())) == sorted(map(tuple, tokens[key].to_numpy().tolist()))


def test_stored_tables_are_deleted(spark):
    since = kernels.stored_so_far()
    gone, kept = kernels.stored(spark.range(3)), kernels.stored(spark.range(5))
    files = gone.inputFiles()
    kernels.drop_stored(spark, since, keep_last=True)
    assert kept.count() == 5 and kernels.stored_so_far() == since + 1 and not any(os.path.exists(f.removeprefix("file://")) for f in files)

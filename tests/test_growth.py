"""What keeps the queries' work in proportion to their tables: texts parsed once, joins by file, sorts led by a hash."""

import pytest
from pyspark.sql import functions as F

from code_analytics.operators import diffs, findings
from code_analytics.plans import code_queries, review_queries
from code_analytics.sources import tree
from tests.conftest import SF


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q12_matching_symbols", "d4_diff_context", "d6_pack_context"])
def test_symbols_are_parsed_once(spark, name):
    """Parsed texts are a table of their own, so the query's plan holds no parser."""
    query = getattr(code_queries, name, None) or getattr(review_queries, name)
    assert "ArrowEvalPython" not in _plan(query(spark, SF))


def test_only_the_asked_language_is_parsed(spark, monkeypatch):
    seen = []
    plain = code_queries.I.extract_imports
    monkeypatch.setattr(code_queries.I, "extract_imports", lambda files: seen.append({r[0] for r in files.select("language").distinct().collect()}) or plain(files))
    code_queries.i3_resolve_js(spark, SF)
    code_queries.i2_resolve_python(spark, SF)
    assert "python" not in seen[0] and seen[1] == {"python"}


def test_merged_ranges_are_sorted_by_a_hash(spark):
    ranges = spark.createDataFrame([("r", "f", 1, 2), ("r", "f", 3, 5), ("r", "f", 3, 5), ("r", "f", 9, 9), ("r", "g", 1, 1)], "repo string, file string, start int, stop int")
    out = diffs.merged_ranges(ranges, "repo", "file")
    assert "Sort [_hash" in _plan(out)
    assert sorted(map(tuple, out.collect())) == [("r", "f", 1, 5), ("r", "f", 9, 9), ("r", "g", 1, 1)]


def test_findings_meet_ranges_in_one_join(spark):
    """A finding beyond the end of its file stays where a changed range holds its line; findings of one number are told apart."""
    rows = [("n", 1, "r", "f.py", 70, "x", "y"), ("n", 1, "r", "f.py", 99, "x", "y"), ("n", 2, "r", "f.py", 1, "x", "y"), ("n", 3, "r", "f.py", 1, "syntax error", "y")]
    found = spark.createDataFrame(rows, "run_id string, seq int, repo string, file string, line int, description string, fix_sketch string")
    index = spark.createDataFrame([("r", "f.py", "def (", 1, "python")], "repo string, file_path string, content string, line_count int, language string")
    hunks = spark.createDataFrame([("r", "f.py", "@@ -1 +60,12 @@"), ("r", "f.py", "@@ -1 +60,30 @@")], "repo string, file_path string, patch string")
    got = sorted((r.seq, r.line, r.reason or "") for r in findings.verify_findings(found, index, hunks).collect())
    assert got == [(1, 70, ""), (1, 99, "line beyond end of file"), (2, 1, ""), (3, 1, "")]


def test_importers_of_a_file_serve_all_requests(spark):
    context = spark.createDataFrame([("r", 1, "f", "a"), ("r", 2, "f", "")], "repo string, pr_number int, file_path string, changed string")
    index = spark.createDataFrame([("r", "f", "one\ntwo")], "repo string, file_path string, content string")
    who = spark.createDataFrame([("r", "f", x) for x in "abcdefab"], "repo string, file_path string, src_file string")
    want = {n: r.prompt for n, r in zip((1, 2), diffs.pack_context(context, index, who.crossJoin(spark.createDataFrame([(1,), (2,)], "pr_number int")), cap=9).orderBy("pr_number").collect())}
    assert {r.pr_number: r.prompt for r in diffs.pack_context(context, index, who, cap=9).collect()} == want
    assert want[1] == "file f\nchanged a\nimported by a,b,c,d,e (+1 more)\n1: one\n2:"


def test_a_tree_without_archives_is_listed_once(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("x")
    assert _plan(tree.scanned(spark, str(tmp_path / "t"), "r")).count("Scan binaryFile") == 1


def test_every_window_is_remembered(spark):
    """op5: the windows that the memory counts are those of all words."""
    from code_analytics.llm import lm_scoring

    df = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c x e f g h i")], "doc_id long, text string")
    vocab, net = lm_scoring.trained(df)
    rows = lm_scoring.network_scores(df, vocab, net).select("n_words", F.length("windows").alias("n")).collect()
    assert all(r.n == r.n_words * lm_scoring.WINDOWS.itemsize for r in rows)


def test_nearest_lists_hold_a_part_of_the_rows():
    """q8_vector_index: the distances to all lists are held for a part of a batch only."""
    import tracemalloc

    import numpy as np

    from code_analytics.operators import vectors

    r = np.random.default_rng(1)
    x, centroids = r.normal(size=(5_000, 8)), r.normal(size=(8_000, 8))
    tracemalloc.start()
    near = vectors.nearest_lists(x, centroids, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * vectors.NEAR_BYTES
    assert (near[:50] == np.argsort(-(x[:50] @ centroids.T), axis=1, kind="stable")[:, :3]).all()


def test_memory_stores_no_windows(spark):
    """op5: no table of all windows is written, and windows that stand once are not counted."""
    import numpy as np
    import pyarrow as pa

    from code_analytics.llm import kernels, lm_scoring

    before = kernels.stored_so_far()
    df = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e x y z"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.remembered for r in lm_scoring.scored(df, *lm_scoring.trained(df)).collect()}
    assert got == {1: 3 / 8, 2: 3 / 8, 3: None}
    empty = df.where("doc_id = 3")
    assert [r.n_words for r in lm_scoring.scored(empty, *lm_scoring.trained(empty)).collect()] == [0]
    assert kernels.stored_so_far() == before
    rows = pa.table({"g": [0], "doc_id": [1], "text": ["a b c d e f g h"]})
    assert not len(lm_scoring.Remembered(rows, np.zeros(8, np.uint8), 0).windows)


def test_classes_are_small_around_a_word():
    """op5: the softmax within a class goes over fewer tokens a word than with classes of equal counts (there as many as tokens / classes), on any scale."""
    import numpy as np

    from code_analytics.llm import lm_scoring

    for top in lm_scoring.TOKENS:
        n, bins = 1e9 / np.arange(1, top + 1), np.full(top // 8, 1e4)
        vocab, weight = lm_scoring.Vocabulary.of(np.arange(top, dtype=np.uint64) << np.uint64(40), n, bins, bins / 10)
        own = np.add.reduceat(weight, vocab.first[:-1])
        assert (own * np.diff(vocab.first)).sum() / own.sum() < 0.7 * vocab.edge / lm_scoring.CLASSES
        assert len(own) <= lm_scoring.CLASSES and (vocab.tokens(vocab.keys) == vocab.key_token).all()


def test_the_order_of_a_group_changes_no_entries(monkeypatch):
    """op5: a group's texts come in another order each time they are read."""
    import numpy as np
    import pyarrow as pa

    from code_analytics.llm import lm_scoring

    texts = ["a b c d e f g h", "a b c x y z", "p q a b c d e f", "g h a b c d"]
    bits = np.array([1, 0, 0, 1] * 8, np.uint8)

    def entries(order):
        rows = pa.table({"g": [0] * 4, "doc_id": order, "text": [texts[k] for k in order]})
        return lm_scoring.Remembered(rows, bits, 0).entries(3)

    want = entries([0, 1, 2, 3])
    assert want and entries([2, 0, 3, 1]) == want
    monkeypatch.setattr(lm_scoring, "PRINT_BITS", 63)
    assert sum(lm_scoring.Remembered(pa.table({"g": [0], "doc_id": [0], "text": [texts[0] + " " + texts[0]]}), bits * 0, 0).counts) == 8


def test_siblings_come_from_a_row_for_each_directory(spark):
    """g2: the rows of siblings are not shuffled and numbered again; a large directory joins one row."""
    from code_analytics.operators import graph

    names = sorted(f"d/m{k}.py" for k in range(40))
    index = spark.createDataFrame([("r", n) for n in [*names, "top.py"]], "repo string, file_path string")
    edges = spark.createDataFrame([], "repo string, src_file string, dst_file string, raw_import string, language string")
    out = graph.neighborhood(index, edges, index)
    got = {}
    for r in out.where("relation = 'sibling'").orderBy("file_path", "ordinal").collect():
        got.setdefault(r.file_path, []).append(r.other)
    assert got == {n: [x for x in names if x != n][:10] for n in names}
    assert _plan(out.where("relation = 'sibling'")).count("Window [") == 1


def test_patterns_of_an_import_are_matched_once(spark):
    """g2: the stored imports hold the module, so no filter behind them matches patterns on the raw text of Python again."""
    from code_analytics.operators import imports

    rows = spark.createDataFrame([("r", "a/b.py", "python", 0, "from ..c import d;"), ("r", "a/b.py", "python", 1, "import e.f"), ("r", "a/b.js", "javascript", 0, "import x from './y'")], "repo string, file_path string, language string, ord int, raw string")
    held = rows.withColumn("module", imports.module_of(rows))
    assert [r.module for r in held.orderBy("language", "ord").collect()] == [None, "..c", "e.f"]
    assert [(r.dots, r.tail) for r in imports.python_modules(held).orderBy("ord").collect()] == [(2, "c"), (0, "e/f")]
    files = rows.select("repo", "file_path")
    plan = _plan(imports.resolve_imports(rows, files, imports.package_roots(files)))
    assert "^from" not in plan and "^import" not in plan

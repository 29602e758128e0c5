"""Small literal tables for what the corpus queries don't show."""

import hashlib
import hmac
import os
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from code_analytics.operators import changes, decisions, diffs, events, findings, graph, imports, preflight, search, selection, symbols
from code_analytics.sources.tables import VersionedTable
from code_analytics.sources.tree import scan_files
from code_analytics.streaming import admission

PROJECT = {
    "src/app/__init__.py": "",
    "src/app/utils.py": "import os\n\n\ndef helper(x):\n    return x\n",
    "src/app/models.py": 'from app.utils import helper\n\n\n@wrap\n@other(1)\nclass User(Base):\n    """A user."""\n\n    async def save(self, deep=True) -> bool:\n        """Save it."""\n        def inner():\n            pass\n        return helper(self)\n\n    @property\n    def name(self):\n        return 1\n',
    "src/app/core.py": "from .utils import (\n    helper,\n)\nfrom app.models import User\nimport numpy as np, sys\n\n\ndef main():\n    return User()\n",
    "tests/test_core.py": "from app import core\n\n\ndef test():\n    core.main()\n",
    "web/a.ts": "import { b } from './b';\nimport x from 'react';\n\n/** Does it. */\nexport async function go(n: number): string {\n  if (n) {\n    return 'a';\n  }\n}\n\nexport class Box extends Base {\n  open(a) {\n    return a;\n  }\n}\n\ninterface Shape {\n  side: number;\n}\n\nconst add = (a, b) => {\n  return a + b;\n};\n",
    "web/b/index.ts": "export function b() {\n}\n",
    "setup.toml": "x = 1\n",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("r", p, c) for p, c in PROJECT.items()], "repo string, file_path string, content string")


@pytest.fixture(scope="module")
def edges(files):
    return imports.resolve_imports(imports.extract_imports(selection.select_source_files(files)), files, imports.package_roots(files))


def test_selection(files):
    assert {r.file_path for r in selection.select_source_files(files).collect()} == set(PROJECT) - {"tests/test_core.py", "setup.toml"}
    assert "tests/test_core.py" in {r.file_path for r in selection.select_source_files(files, include_tests=True).collect()}


def test_selection_rules(spark):
    names = ["a.py", ".py", "b.tsx", "b.JS", "x/node_modules/c.js", "d.min.js", "e_pb2.py", "f.d.ts", "spec/g.py", "h.mjs", "big.py", "edge.py"]
    size = {"big.py": 200_001, "edge.py": 200_000}
    df = spark.createDataFrame([("r", n, "x" * size.get(n, 3)) for n in names], "repo string, file_path string, content string")
    assert {r.file_path for r in selection.select_source_files(df).collect()} == {"a.py", "h.mjs", "edge.py"}


def test_line_count(spark):
    df = spark.createDataFrame([("", 1), ("a", 1), ("a\n", 1), ("a\nb", 2), ("\n\n", 2)], "content string, n int")
    assert all(r.n == r.m for r in df.withColumn("m", selection.line_count(F.col("content"))).collect())


def test_edges(edges):
    got = {(r.src_file, r.raw_import.split("\n")[0], r.dst_file) for r in edges.collect()}
    assert got == {
        ("src/app/utils.py", "import os", None),
        ("src/app/models.py", "from app.utils import helper", "src/app/utils.py"),
        ("src/app/core.py", "from .utils import (", "src/app/utils.py"),
        ("src/app/core.py", "from app.models import User", "src/app/models.py"),
        ("src/app/core.py", "import numpy as np, sys", None),
        ("web/a.ts", "import { b } from './b';", "web/b/index.ts"),
        ("web/a.ts", "import x from 'react';", None),
    }


@pytest.mark.parametrize(
    "raw, path, target",
    [
        ("from . import x", "p/q/a.py", "p/q/__init__.py"),
        ("from .. import x", "p/q/a.py", "p/__init__.py"),
        ("from ..b import x", "p/q/a.py", "p/b.py"),
        ("import p.b as c, d;", "z.py", "p/b.py"),
        ("from p.q import x", "z.py", "p/q/__init__.py"),
        ("from .... import x", "p/q/a.py", None),
        ("import nothing", "z.py", None),
    ],
)
def test_python_resolution(spark, raw, path, target):
    there = spark.createDataFrame([("r", p, "") for p in ("p/__init__.py", "p/b.py", "p/q/__init__.py", "p/q/a.py", "z.py")], "repo string, file_path string, content string")
    row = spark.createDataFrame([("r", path, "python", 0, raw)], "repo string, file_path string, language string, ord int, raw string")
    assert imports.resolve_imports(row, there, imports.package_roots(there)).first().dst_file == target


def test_js_leaving_the_repository(spark):
    there = spark.createDataFrame([("r", "a.js", "")], "repo string, file_path string, content string")
    row = spark.createDataFrame([("r", "b/c.js", "javascript", 0, "import x from '../../a'"), ("r", "b/d.js", "javascript", 0, "import x from '../a'")], "repo string, file_path string, language string, ord int, raw string")
    assert {r.src_file: r.dst_file for r in imports.resolve_imports(row, there, imports.package_roots(there)).collect()} == {"b/c.js": None, "b/d.js": "a.js"}


def test_symbols(files):
    got = {(r.file_path, r.name): r for r in symbols.extract_symbols(selection.select_source_files(files)).collect()}
    user, save, inner, name = (got["src/app/models.py", n] for n in ("User", "save", "inner", "name"))
    assert (user.kind, user.start_line, user.end_line, user.docstring, user.decorators) == ("class", 6, 17, "A user.", ["@wrap", "@other(1)"])
    assert (save.kind, save.parent_class, save.end_line, save.docstring) == ("async_method", "User", 13, "Save it.")
    assert save.signature == "async def save(self, deep=True) -> bool"
    assert (inner.kind, inner.parent_class) == ("method", "User")
    assert (name.kind, name.decorators) == ("method", ["@property"])
    go, box, open_, shape, add = (got["web/a.ts", n] for n in ("go", "Box", "open", "Shape", "add"))
    assert (go.kind, go.start_line, go.end_line, go.docstring) == ("async_function", 5, 9, "Does it.")
    assert (box.kind, box.end_line, open_.kind, open_.parent_class, shape.kind, add.kind, add.end_line) == ("class", 15, "method", "Box", "interface", "function", 23)


def test_load_bearing(files, edges):
    index = selection.select_source_files(files).withColumn("line_count", selection.line_count(F.col("content")))
    top = {r.file_path: r.in_degree for r in graph.load_bearing(index, edges, 50).collect()}
    assert top["src/app/utils.py"] == 2 and top["src/app/models.py"] == 1 and top["src/app/core.py"] == 0
    with pytest.raises(ValueError):
        graph.load_bearing(index, edges, 0)


def test_changed_ranges(spark):
    df = spark.createDataFrame([("@@ -1,2 +3,4 @@ x\n@@ -1 +9 @@\n@@ -5,1 +7,0 @@",), (None,), ("binary",)], "patch string")
    assert [[tuple(x) for x in r.r] for r in df.select(diffs.changed_ranges(F.col("patch")).alias("r")).collect()] == [[(3, 6), (9, 9), (7, 7)], [], []]


def test_code_slice(spark):
    text = "\n".join(f"l{i}" for i in range(1, 13))
    df = spark.createDataFrame([(text, 9, 40)], "c string, a int, b int")
    assert df.select(search.code_slice(F.col("c"), F.col("a"), F.col("b"))).first()[0] == " 9: l9\n10: l10\n11: l11\n12: l12"


def _covers(tokens, terms):
    spans = {(i, j) for i in range(len(tokens)) for j in range(i, len(tokens)) if set(terms) <= set(tokens[i : j + 1])}
    minimal = [s for s in spans if not any(o != s and o[0] >= s[0] and o[1] <= s[1] for o in spans)]
    return round(sum(0.1 / (1 + sum(t not in terms for t in tokens[i : j + 1])) for i, j in minimal), 6)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=12), min_size=1, max_size=6))
def test_cover_density(spark, docs):
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id int, text string")
    q = spark.createDataFrame([("a b",)], "query string")
    got = {r.doc_id: r["rank"] for r in search.cover_density(search.tokenize(df, "doc_id"), q, "doc_id").collect()}
    assert got == {i: _covers(d, ["a", "b"]) for i, d in enumerate(docs) if {"a", "b"} <= set(d)}


def test_signatures(spark):
    rows = [(1, " Org/R ", "comment", 3, None, "hello  "), (2, "org/r", "comment", 3, None, "hello"), (3, "org/r", "comment", None, None, "hello"), (4, "org/r", "create_issue", None, " Title ", "x")]
    df = spark.createDataFrame(rows, "seq int, repo string, action string, issue int, title string, body string")
    s = {r.seq: r.signature for r in decisions.decision_signature(df).collect()}
    assert s[1] == s[2] == hashlib.sha256(b"org/r\ncomment\n3\nhello").hexdigest()
    assert s[3] == hashlib.sha256(b"org/r\ncomment\nNone\nhello").hexdigest()
    assert s[4] == hashlib.sha256(b"org/r\ncreate_issue\ntitle").hexdigest()
    for bad in ((1, "r", "dance", 1, None, None), (1, None, "comment", 1, None, None)):
        with pytest.raises(Exception, match="no signature|needs a repo"):
            decisions.decision_signature(spark.createDataFrame([bad], df.schema)).collect()


def test_gate_and_log(spark, tmp_path):
    rows = [(1, "r", "a", "comment", 1, "x", 0.9, True), (2, "r", "a", "comment", 1, "x", 0.9, True), (3, "r", "a", "close_issue", 2, None, 0.1, True), (4, "r", "a", "close_issue", 3, None, 0.9, None), (5, "r", "a", "close_issue", 4, None, 0.9, False), (6, "r", "b", "comment", 1, "x", 0.9, True)]
    df = spark.createDataFrame(rows, "seq long, repo string, agent string, action string, issue int, body string, confidence double, client_ok boolean")
    full = decisions.gate_decisions(df, "full")
    assert {r.seq: r.outcome for r in full.collect()} == {1: "executed", 2: "deduped", 3: "downgraded_low_confidence", 4: "rejected_no_client", 5: "error", 6: "executed"}
    log = VersionedTable(spark, str(tmp_path / "log"), decisions.LOG_SCHEMA, "repo_key", 2)
    decisions.append_actions(log, full)
    again = decisions.gate_decisions(df, "full", decisions.recorded_actions(log))
    assert {r.seq for r in again.where("outcome = 'deduped'").collect()} == {1, 2, 3, 6}
    assert {r.outcome for r in decisions.gate_decisions(df.where("confidence > 0.5"), "shadow").collect()} == {"shadow_logged", "deduped"}
    with pytest.raises(Exception, match="no threshold"):
        decisions.with_threshold(df.withColumn("action", F.lit("add_label"))).collect()


def test_hmac(spark):
    df = spark.createDataFrame([("{}",), ("ünïcode",), ("",)], "raw string")
    for secret in (b"k", b"x" * 100):
        for r in df.select("raw", events.hmac_sha256(F.col("raw"), secret).alias("h")).collect():
            assert r.h == hmac.new(secret, r.raw.encode(), hashlib.sha256).hexdigest()


def _accepted(rows, window):
    last, out = None, []
    for t, i in sorted(rows):
        if last is None or t - last >= window:
            last = t
            out.append(i)
    return set(out)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 300), min_size=1, max_size=25))
def test_cooldown(spark, times):
    df = spark.createDataFrame([(i, "K", t) for i, t in enumerate(times)], "id long, key string, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.id for r in events.cooldown(df, F.col("key"), "ts", "id", 60).collect()}
    assert got == _accepted([(t, i) for i, t in enumerate(times)], 60)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"k{i % 3}", 10_000 + (i * 37) % 500) for i in range(60)]
    schema = "id long, key string, t long"
    for part in range(3):
        spark.createDataFrame(rows[part::3] if part < 2 else rows[2::3], schema).withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.parquet(str(tmp_path / "in" / f"{part}"))
    spark.createDataFrame([(999, "end", 100000), (1000, "end", 200000)], schema).withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.parquet(str(tmp_path / "in" / "9"))
    stream = spark.readStream.schema("id long, key string, t long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = admission.cooldown(stream.drop("t"), 60.0, "1 hour").writeStream.format("memory").queryName("accepted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.id for r in spark.table("accepted").collect()} - {999, 1000}
    assert got == {i for k in range(3) for i in _accepted([(t, i) for i, key, t in rows if key == f"k{k}"], 60)}


def test_responses_and_verdicts(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, '{"a": "no", "b": "x"}'), (3, "{"), (4, None)], "id int, raw string")
    ok, bad = findings.parse_responses(df, "a int, b string", ("a", "b"))
    assert [r.id for r in ok.collect()] == [1] and sorted(r.id for r in bad.collect()) == [2, 3, 4]


def test_verification(spark):
    index = spark.createDataFrame([("r", "a.py", "python", 3, "x = 1\n"), ("r", "bad.py", "python", 1, "def (:\n")], "repo string, file_path string, language string, line_count int, content string")
    rows = [(1, "none.py", 1, "d", ""), (2, "a.py", 9, "d", ""), (3, "a.py", 1, "Syntax error here", ""), (4, "bad.py", 1, "syntax error", ""), (5, "a.py", 1, "ok", "Add more tests"), (6, "a.py", 3, "ok", "guard")]
    df = spark.createDataFrame([(1, s, "r", f, ln, d, x) for s, f, ln, d, x in rows], "run_id int, seq int, repo string, file string, line int, description string, fix_sketch string")
    got = {r.seq: r.reason for r in findings.verify_findings(df, index).collect()}
    assert got == {1: "file not in index", 2: "line beyond end of file", 3: "claims a syntax error but parses", 4: None, 5: r"banned phrase: add (?:more )?tests", 6: None}


def test_preflight(files):
    targets = files.where("file_path like 'src/app/%.py'")
    got = {r.file_path: r.reason for r in preflight.has_existing_tests(targets, files, imports.package_roots(files)).collect()}
    assert got["src/app/core.py"] == "tests_exist:in_test_dir:tests/test_core.py" and got["src/app/utils.py"] is None


def test_upsert_and_modes(spark):
    df = spark.createDataFrame([(None, "b", True), ("a", None, True), ("a", "a", True), ("a", "b", True), ("a", "b", False)], "old_sha string, new_sha string, has_changes boolean")
    assert [r.mode for r in changes.index_mode(df).collect()] == ["full", "full", "noop", "incremental", "full"]


def test_scan(spark, tmp_path):
    os.makedirs(tmp_path / "tree" / "sub")
    (tmp_path / "tree" / "a.py").write_text("x = 1\n")
    (tmp_path / "tree" / "sub" / "b.py").write_bytes(b"\xff\xfe\x00")
    with zipfile.ZipFile(tmp_path / "tree" / "sub" / "c.zip", "w") as z:
        z.writestr("d/e.py", "y = 2\n")
        z.writestr("d/f.py", b"\xff")
        z.mkdir("empty")
    (tmp_path / "tree" / "bad.zip").write_bytes(b"no zip")
    files, rejects = scan_files(spark, str(tmp_path / "tree"), "r")
    assert sorted((r.file_path, r.size, r.content) for r in files.collect()) == [("a.py", 6, "x = 1\n"), ("sub/c.zip/d/e.py", 6, "y = 2\n")]
    assert sorted((r.file_path, r.reason) for r in rejects.collect()) == [("bad.zip", "no archive"), ("sub/b.py", "not UTF-8"), ("sub/c.zip/d/f.py", "not UTF-8")]
    assert {r.file_path: r.reason for r in scan_files(spark, str(tmp_path / "tree"), "r", archives=False)[1].collect()}["sub/c.zip"] == "not UTF-8"


def test_admit_stream_equals_batch(spark, tmp_path):
    """Cooldown and duplicates in micro-batches, one of them late, and the same jobs as one table."""
    rows = [(i, f"org/r{i % 3}", f"job{(i * 7) % 5}", 10_000 + (i * 97) % 900) for i in range(90)]
    schema = "delivery_id long, repo_key string, job_id string, t long"
    jobs = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("t")).drop("t")
    for part in range(3):
        spark.createDataFrame(rows[part::3], schema).withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.parquet(str(tmp_path / "in" / f"{part}"))
    spark.createDataFrame([(999, "end", "x", 100000), (1000, "end", "x", 200000)], schema).withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.parquet(str(tmp_path / "in" / "9"))
    stream = spark.readStream.schema(schema + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")).drop("t")
    q = admission.admit(stream, 60.0, 120.0, "1 hour").writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.delivery_id: r.outcome for r in spark.table("admitted").collect() if r.delivery_id < 999}
    want = {r.delivery_id: r.outcome for r in events.admit(jobs, 60.0, 120.0).collect()}
    assert got == want and len(got) == 90 and set(want.values()) == {"dispatched", "cooldown", "duplicate"}


def test_admit_by_brute_force(spark):
    """Keys with and without gaps against one walk over all jobs."""
    rows = [(i, f"r{i % 4}", f"j{(i * 5) % 7}", (i * 131) % 4000 + (i % 4) * 10_000 * (i % 3)) for i in range(300)]
    last, live, want = {}, {}, {}
    for i, key, job, t in sorted(rows, key=lambda r: (r[3], r[0])):
        if key in last and t - last[key] < 30:
            want[i] = "cooldown"
        elif (key, job) in live and t - live[key, job] < 200:
            want[i] = "duplicate"
        else:
            want[i], last[key], live[key, job] = "dispatched", t, t
    jobs = spark.createDataFrame(rows, "delivery_id long, repo_key string, job_id string, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert {r.delivery_id: r.outcome for r in events.admit(jobs, 30.0, 200.0).collect()} == want


def test_checklist(spark):
    found = spark.createDataFrame([(1, "a.py", 3, "Possible null", "guard"), (1, "", 0, "add docs", ""), (2, "b.py", 1, "leak", "close")], "run_id int, file string, line int, description string, fix_sketch string")
    stones = spark.createDataFrame([(1, "Add tests", "null checks"), (1, "Guard inputs", ""), (2, "Close files", "about leaks")], "run_id int, title string, summary string")
    rules = [("null", "must", "null", 0), ("docs", "must_not", "docs", 0), ("two", "min_findings", "", 2), ("cited", "file_line", "", 0), ("one", "max_milestones", "", 1), ("tests", "banned_title", "add tests", 0), ("says", "summary", "null", 0)]
    got = {(r.run_id, r.rule, r.violations) for r in findings.check_outputs(found, spark.createDataFrame(rules, "rule string, kind string, pattern string, n long"), stones).collect()}
    assert got == {(1, "docs", 1), (1, "cited", 1), (1, "one", 1), (1, "tests", 1), (2, "null", 1), (2, "two", 1), (2, "says", 1)}


def test_prior_attempts(files, spark):
    py = files.where("file_path like 'src/app/%.py'")
    index = selection.select_source_files(py).withColumn("line_count", selection.line_count(F.col("content")))
    log = spark.createDataFrame([("R", "test_generator", ["x", "target_file:src/app/models.py"]), ("r", "pr_reviewer", ["target_file:src/app/utils.py"])], "repo string, agent string, evidence array<string>")
    got = {r.file_path: r.reason for r in preflight.is_feasible(py, index, symbols.extract_symbols(index), log).collect()}
    assert got["src/app/models.py"] == "prior_attempt" and got["src/app/utils.py"] is None and got["src/app/__init__.py"] == "no_symbols"


def test_load_bearing_with_symbols(files, edges):
    index = selection.select_source_files(files)
    top = {r.file_path: [(x.start_line, x.name) for x in r.symbols] for r in graph.load_bearing(index, edges, 50, symbols.extract_symbols(index)).collect()}
    assert top["src/app/models.py"] == [(6, "User"), (9, "save"), (11, "inner"), (16, "name")] and top["src/app/__init__.py"] == []


def test_neighborhood_of_unknown_files(files, edges, spark):
    index = selection.select_source_files(files)
    asked = spark.createDataFrame([("r", "src\\app\\core.py"), ("r", "none.py")], "repo string, file_path string")
    got = {(r.file_path, r.relation, r.other) for r in graph.neighborhood(index, edges, asked).collect()}
    assert {x[0] for x in got} == {"src/app/core.py"} and ("src/app/core.py", "imports", "src/app/utils.py") in got and ("src/app/core.py", "sibling", "src/app/models.py") in got
    with pytest.raises(Exception, match="no such file in the index: r none.py"):
        graph.neighborhood(index, edges, asked, strict=True).collect()


def test_embed(spark):
    df = spark.createDataFrame([(1, "abc"), (2, ""), (3, None), (4, "x" * 9000)], "id int, content string").coalesce(1)
    got = {r.id: r.embedding for r in search.embed(df, lambda texts: [[len(t), 1.0] for t in texts]).collect()}
    assert got == {1: [3.0, 1.0], 2: None, 3: None, 4: [8000.0, 1.0]}
    assert {r.embedding for r in search.embed(df, lambda texts: [[1.0]]).collect()} == {None}

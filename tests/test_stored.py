"""Stored tables, logs and streams: replays, crashes, restarts and concurrent writers."""

import glob
import os
import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from code_analytics.functions.parsing import python_structure
from code_analytics.operators import changes, decisions, events, graph, preflight
from code_analytics.sources import shared, tables
from code_analytics.sources.tables import VersionedTable
from code_analytics.streaming import admission, reindex

FILES = "repo string, file_path string, content string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def index(spark, tmp_path):
    out = VersionedTable(spark, str(tmp_path / "index"), FILES, n_buckets=4)
    out.append(spark.createDataFrame([(f"r{i}", f"{p}.py", f"{i}{p}") for i in range(6) for p in "ab"], FILES))
    return out


def _data(index):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{index.path}/data/**/*.parquet", recursive=True)}


def test_rebuild_leaves_other_buckets_alone(spark, index):
    before, old = _data(index), index.manifest()
    fresh = spark.createDataFrame([("r1", "c.py", "new")], FILES)
    assert changes.rebuild_stored(index, fresh) == 2
    want = [(f"r{i}", f"{p}.py", f"{i}{p}") for i in range(6) for p in "ab" if i != 1] + [("r1", "c.py", "new")]
    assert rows(index.read().drop("published")) == sorted(want)
    assert {p: _data(index)[p] for p in before} == before  # nothing was written again
    mine = {str(fresh.select(index.bucket()).first()[0])}
    now = index.manifest()["folders"]
    assert {b for b in now if now[b] != old["folders"].get(b)} == mine
    assert rows(index.read(1).drop("published")) == sorted((f"r{i}", f"{p}.py", f"{i}{p}") for i in range(6) for p in "ab")  # readers of version 1 still can


def test_batches_are_applied_once(spark, index):
    merge = reindex.merge_batches(index, "s")
    batch = lambda *r: spark.createDataFrame(r, reindex.CHANGES)
    at = lambda n: datetime(2026, 1, 1, 0, n)
    first = batch(("r0", "a.py", "deleted", None, at(1)), ("r0", "b.py", "modified", "old", at(1)), ("r0", "b.py", "modified", "B", at(2)), ("r9", "n.py", "added", "N", at(1)), ("r9", "n.txt", "added", "x", at(1)))
    merge(first, 0)
    state, version = rows(index.read().drop("published")), index.manifest()["version"]
    assert ("r0", "b.py", "B") in state and ("r9", "n.py", "N") in state and not any(r[1] in ("n.txt",) or r[:2] == ("r0", "a.py") for r in state)
    merge(first, 0)
    assert index.manifest()["version"] == version and rows(index.read().drop("published")) == state
    merge(batch(("r0", "b.py", "deleted", None, at(3))), 1)
    merge(first, 0)  # an old batch doesn't bring back what a later one took away
    assert ("r0", "b.py", "B") not in rows(index.read().drop("published"))


def test_crash_between_write_and_commit(spark, index, monkeypatch):
    """The rows are written, the manifest is not: the batch comes again and is merged once."""
    one = spark.createDataFrame([("r2", "a.py", "modified", "2", None)], reindex.CHANGES)
    before = rows(index.read().drop("published"))

    def crash(self, manifest):
        raise RuntimeError("gone")

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_publish", crash)
        with pytest.raises(RuntimeError):
            reindex.merge_batches(index, "s")(one, 0)
    assert rows(index.read().drop("published")) == before
    reindex.merge_batches(index, "s")(one, 0)
    reindex.merge_batches(index, "s")(one, 0)
    assert rows(index.read().drop("published")) == sorted([r for r in before if r[:2] != ("r2", "a.py")] + [("r2", "a.py", "2")])


def test_stream_equals_merge(spark, index, tmp_path):
    """Two runs over a growing folder from one checkpoint, and the merge of all changes at once."""
    start = spark.createDataFrame(index.read().drop("published").collect(), FILES)
    parts = [[("r0", "a.py", "modified", "1", None), ("r7", "x.py", "added", "x", None)], [("r3", "b.py", "deleted", None, None)], [("r7", "x.py", "modified", "y", None)]]
    stream = lambda: spark.readStream.schema(reindex.CHANGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for i, part in enumerate(parts):
        spark.createDataFrame(part, reindex.CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i:
            reindex.reindex(stream(), index, str(tmp_path / "cp")).awaitTermination()
    want = start
    for part in parts:
        df = spark.createDataFrame(part, reindex.CHANGES)
        want = changes.merge_files(want, df.select("repo", "file_path", "status"), df.where("status <> 'deleted'").select("repo", "file_path", "content"))
    assert rows(index.read().drop("published")) == rows(want)


def test_conflicting_writers(spark, index, monkeypatch):
    """A manifest that comes in between: of another bucket, and of the same one."""
    repos = {str(r.b): r.repo for r in spark.range(40).select(F.concat(F.lit("r"), "id").alias("repo")).withColumn("b", index.bucket()).collect()}
    mine, other = repos["0"], repos["1"]
    publish = VersionedTable._publish
    for rival in (other, mine):
        calls = []

        def late(self, manifest, rival=rival, calls=calls):
            if not calls:
                calls.append(1)
                changes.rebuild_stored(index, spark.createDataFrame([(rival, "rival.py", "1")], FILES))
            return publish(self, manifest)

        with monkeypatch.context() as m:
            m.setattr(VersionedTable, "_publish", late)
            index.rewrite(spark.createDataFrame([(mine,)], "repo string"), lambda r: r.unionByName(spark.createDataFrame([(mine, "mine.py", rival)], FILES)))
        got = {(r.repo, r.file_path, r.content) for r in index.read().collect()}
        assert (rival, "rival.py", "1") in got and (mine, "mine.py", rival) in got


def test_two_writers_of_the_log(spark, tmp_path):
    log = VersionedTable(spark, str(tmp_path / "log"), decisions.LOG_SCHEMA, "repo_key", 4)
    schema = "seq long, repo string, agent string, action string, issue int, body string, confidence double, client_ok boolean"
    gated = [decisions.gate_decisions(spark.createDataFrame([(10 * w + i, f"r{i}", "a", "comment", 1, "x", 0.9, True) for i in range(5)], schema), "full") for w in range(4)]
    writers = [threading.Thread(target=decisions.append_actions, args=(log, g)) for g in gated]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert log.manifest()["version"] == 4 and log.read().count() == 20
    found = decisions.recorded_actions(log).collect()
    assert sorted(r.repo_key for r in found) == [f"r{i}" for i in range(5)] and {r.published for r in found} == {1}
    again = decisions.gate_decisions(spark.createDataFrame([(99, "r3", "a", "comment", 1, "x", 0.9, True)], schema), "full", decisions.recorded_actions(log))
    assert again.first().outcome == "deduped"


def test_empty_table(spark, tmp_path):
    empty = VersionedTable(spark, str(tmp_path / "none"), FILES)
    assert empty.read().count() == 0
    empty.append(spark.createDataFrame([], FILES))
    assert empty.read().count() == 0 and changes.rebuild_stored(empty, spark.createDataFrame([("r", "a.py", "")], FILES)) == 2 and empty.read().count() == 1


def test_bucketed_tables_need_no_exchange(spark):
    """Load-bearing files over tables bucketed by repository."""
    index = spark.createDataFrame([("r", f"f{i}.py") for i in range(9)], "repo string, file_path string")
    edges = spark.createDataFrame([("r", f"f{i}.py", f"f{i // 3}.py") for i in range(9)], "repo string, src_file string, dst_file string")
    held = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        a, b = tables.bucketed(index, "b_index", "repo", n_buckets=4), tables.bucketed(edges, "b_edges", "repo", n_buckets=4)
        top = graph.load_bearing(a, b)
        assert "Exchange" not in top._jdf.queryExecution().executedPlan().toString()
        assert rows(top) == rows(graph.load_bearing(index, edges))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sql("drop table if exists b_index")
        spark.sql("drop table if exists b_edges")


def test_shared_folder(spark):
    since = shared.stored_so_far()
    there = set(glob.glob(f"{shared.shared_folder(spark)}/stored-*"))
    assert rows(shared.stored(spark.range(3))) == [(0,), (1,), (2,)]
    shared.drop_stored(spark, since)
    assert set(glob.glob(f"{shared.shared_folder(spark)}/stored-*")) == there


def test_admission_over_restarts(spark, tmp_path):
    """Three runs from one checkpoint, rows out of order, one beyond the watermark and two without key or time, against the batch form."""
    schema = "delivery_id long, repo_key string, job_id string, t long"
    jobs = [(i, f"org/r{i % 3}", f"job{(i * 7) % 5}", 10_000 + (i * 97) % 900) for i in range(90)] + [(500, None, "j", 10_050), (501, "org/r0", None, 10_055)]

    def put(some):
        spark.createDataFrame(some, schema).withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(schema + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("t")
        q = admission.admit(stream, 60.0, 120.0, "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    for part in (jobs[0::2], jobs[1::2]):
        put(part)
        run()
    put([(999, "end", "x", 100_000)])
    run()
    put([(1001, "org/r0", "job1", 10_100)])  # the watermark has passed it
    run()
    got = {r.delivery_id: r.outcome for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = spark.createDataFrame(jobs, schema).withColumn("ts", F.timestamp_seconds("t"))
    want = {r.delivery_id: r.outcome for r in events.admit(batch, 60.0, 120.0).collect()}
    assert got == want | {1001: "late"} or got == want | {1001: "late", 999: "dispatched"}
    assert set(want.values()) == {"dispatched", "cooldown", "duplicate"}


def names(text):
    return [s[0] for s in python_structure(text)[0]]


@pytest.mark.parametrize(
    "text, found",
    [
        ("def a():\n    return 1\ndef b():\n    print 'x'\ndef c():\n    return 2\nclass D:\n    def m(self):\n        print 'x'\n    def n(self):\n        return 1\n", "abcDmn"),
        ("".join(f"def {c}():\n    print 'x'\n" for c in "abcdefghijklmnopqrstuvwxyz"), "abcdefghijklmnopqrstuvwxyz"),
        ("\ufeffdef a():\n    pass\n", "a"),
        ("class X(:\n    def m(self):\n        return 1\n    y = = 2\n    def k(self): pass\n", "mk"),
        ("def a():\n    # nothing\ndef b(): pass\n", "ab"),
        ("x = (1,\n 2 3,\n 4)\ndef z(): pass\n", "z"),
        ("def a(): pass\nfoo(\ndef b():\n    pass\ndef c(): pass\n", "abc"),
        ('def a(): pass\nx = """abc\ndef b(): pass\n', "ab"),
        ("try:\n    import a\nexcept ImportError, e:\n    print e\nelif:\n    x\ndef l(): pass\n", "l"),
        ("try:\n    x = 1\ndef l(): pass\n", "l"),
        ("def a(): pass\n\0\ndef b(): pass\n", "ab"),
        ("print 1\n" * 700 + "def a(): pass\n" + "s = '''\ndef no(): pass\n" + "text\n" * 600 + "'''\ndef b(): pass\n", "ab"),
    ],
)
def test_broken_python(text, found):
    assert names(text) == list(found)


def test_imports_of_broken_python():
    assert python_structure("try:\n    import a\nexcept ImportError, e:\n    print e\nfrom b import (c,\n  d)\nimport x y\n")[1] == [("import a", 2), ("from b import (c,\n  d)", 5), ("import x y", 7)]


def test_imported_names(spark):
    text = "try:\n    import myapp.core.deep as d\nexcept: pass\nfrom app import core, (x) # why\nx = 1; from p.q import r; from s import t\nimport\tz\n"
    df = spark.createDataFrame([("r", "tests/test_x.py", text)], FILES)
    got = {r.name for r in preflight.imported_names(df).collect()}
    assert {"myapp", "myapp.core", "myapp.core.deep", "app", "app.core", "core", "p.q", "p.q.r", "r", "s", "s.t", "t", "z"} <= got and "app.myapp" not in got

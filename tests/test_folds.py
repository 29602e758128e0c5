"""Parallel folds against one walk over all rows, with keys that lie in many partitions."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from code_analytics.operators import events, folds


@pytest.fixture(params=[4, 13])
def many_partitions(spark, request):
    """Small tables stay in that many partitions."""
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": str(request.param)}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def accepted(rows, window):
    last, out = {}, [i for i, key, t in rows if key is None or t is None]
    for i, key, t in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[1], r[2], r[0])):
        if key not in last or t - last[key] >= window:
            last[key] = t
            out.append(i)
    return sorted(out)


def outcomes(rows, window, horizon):
    last, live, out = {}, {}, {i: "dispatched" for i, key, _, t in rows if key is None or t is None}
    for i, key, job, t in sorted((r for r in rows if r[1] is not None and r[3] is not None), key=lambda r: (r[1], r[3], r[0])):
        if key in last and t - last[key] < window:
            out[i] = "cooldown"
        elif job is not None and (key, job) in live and t - live[key, job] < horizon:
            out[i] = "duplicate"
        else:
            out[i], last[key], live[key, job] = "dispatched", t, t
    return out


rng = random.Random(3)
LOOSE = [(90_001, None, 3), (90_002, "hot", None), (90_003, None, None), (90_004, None, 3)]
SPACED = {
    "regular": ([(i, "hot", i) for i in range(3000)] + [(10_000 + i, f"k{i % 9}", i * 7) for i in range(500)] + LOOSE, 60),
    "random": ([(i, rng.choice(["hot", "hot", "a", "b"]), rng.randrange(20_000)) for i in range(3000)], 37),
    "wider than a partition": ([(i, "hot", i) for i in range(2500)], 2000),
    "ties": ([(i, "hot", i // 50) for i in range(2500)], 3),
    "silent": ([(i, "hot", i * 100) for i in range(500)], 100),
    "none": ([], 5),
    "loose only": (LOOSE, 5),
}


@pytest.mark.parametrize("case", sorted(SPACED))
def test_spaced(spark, many_partitions, case):
    rows, window = SPACED[case]
    df = spark.createDataFrame(rows, "id long, key string, t long")
    for largest in (50,) if many_partitions == 4 else (folds.BLOCK,):
        assert sorted(r.id for r in folds.spaced(df, window, largest).collect()) == accepted(rows, window)


def test_long_chains_are_composed_in_levels(spark, many_partitions, monkeypatch):
    monkeypatch.setattr(folds, "GROUP", 3)
    for rows, window in (SPACED["regular"], SPACED["wider than a partition"], SPACED["random"]):
        assert sorted(r.id for r in folds.spaced(spark.createDataFrame(rows, "id long, key string, t long"), window).collect()) == accepted(rows, window)


def test_no_window(spark):
    rows = [(1, "a", 1), (2, "a", 1), (3, None, 1)]
    assert sorted(r.id for r in folds.spaced(spark.createDataFrame(rows, "id long, key string, t long"), 0).collect()) == [1, 2, 3]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=60, unique=True), st.integers(1, 80), st.integers(1, 7))
def test_step_functions(times, window, size):
    """Parts of one sequence, one after another, give what a walk over all of it gives from any threshold at its begin."""
    t = np.array(sorted(times))
    parts = [t[i : i + size] for i in range(0, len(t), size)]
    steps = [(p, p[folds.last_of(np.searchsorted(p, p + window))] + window) for p in parts]
    ends, values = folds.followed(iter(steps), window)
    for begin in range(int(t[0]) - 2, int(t[0]) + window):
        e = begin
        for x in t.tolist():
            e = x + window if x >= e else e
        assert folds.applied(ends, values, np.array([begin]))[0] == e
    walk = folds.orbit(np.searchsorted(t, t + window), 0)
    assert t[walk].tolist() == [t.tolist()[i] for i in accepted([(i, "k", x) for i, x in enumerate(t.tolist())], window)]


LOOSE_JOBS = [(90_001, None, "j", 5), (90_002, "hot", "j", None), (90_003, "hot", None, 50), (90_004, None, None, None)]
GATED = {
    "regular": ([(i, "hot", f"j{i % 5}", i) for i in range(2000)] + LOOSE_JOBS, 60, 200),
    "random": ([(i, rng.choice(["hot", "a"]), f"j{rng.randrange(30)}", rng.randrange(20_000)) for i in range(2000)], 11, 700),
    "gates that never meet": ([(i, "hot", f"j{i}", i) for i in range(1500)], 7, 50),
    "many keys": ([(i, f"k{rng.randrange(40)}", f"j{rng.randrange(3)}", rng.randrange(3_000)) for i in range(1500)], 5, 90),
    "none": ([], 5, 9),
    "loose only": ([r for r in LOOSE_JOBS if r[1] is None], 5, 9),
}


@pytest.mark.parametrize("case", sorted(GATED))
def test_gated(spark, many_partitions, case):
    rows, window, horizon = GATED[case]
    df = spark.createDataFrame(rows, "id long, key string, job string, t long")
    got = folds.gated(df, window, horizon, largest=64).collect()
    assert len(got) == len(rows) and {r.id: r.outcome for r in got} == outcomes(rows, window, horizon)


def test_few_rows_are_run_twice(spark, many_partitions):
    """One busy key: gates meet soon, so only the begin of each partition is run again."""
    r = random.Random(9)
    rows = [(i, "hot", f"j{r.randrange(50)}", r.randrange(400_000)) for i in range(40_000)]
    jobs = spark.createDataFrame(rows, "delivery_id long, repo_key string, job_id string, t long").withColumn("ts", F.timestamp_micros("t"))
    got = events.admit(jobs, 20e-6, 200e-6, reruns=True).collect()
    assert {r.delivery_id: r.outcome for r in got} == outcomes(rows, 20, 200)
    assert 0 < sum(r.rerun for r in got) < 0.01 * many_partitions * len(rows) / 5


def test_one_key_is_many_tasks(spark, many_partitions):
    """A key with all rows: no task of the survey holds more than a few partitions' share."""
    df = spark.createDataFrame([(i, "hot", i * 3) for i in range(20_000)], "id long, key string, t long")
    sizes = [r["count"] for r in folds.ordered(df).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 0.8 * many_partitions and max(sizes) < 4 * 20_000 / many_partitions

"""Greedy folds over the rows of a key in the order of time, in parallel also inside one key.

All rows are sorted by ranges of (key, t, id), so a partition is a run of the one sequence of all keys, whatever the size of
a key. A fold starts anew at another key and after a silent stretch; only the head of a partition, up to the first such
place, depends on the partition before. What a task learns of its partition is one row (a `Tail`), and these rows, one a
partition, are linked on the driver.

`spaced` (accepted rows lie at least a window apart): the next accepted row is the first one a window later, so accepted rows
are the orbit of a pointer. A head without a new start is a step function from the threshold at its begin (no row before it
is accepted) to the threshold at its end. Tasks find it by pointer doubling over blocks; chains of heads are composed in
groups of GROUP, level by level, and the thresholds are handed down again. Then every head marks its own orbit.

`gated` (cooldown first, then duplicates): heads are run from an empty gate. Where the gate before isn't empty, the head is
run again, only as far as the two gates differ; two gates meet fast, as a dispatch in both closes the same window. The
rounds end when no gate at the end of a head has changed.

Rows without key or time meet no gate: they are accepted, and block nothing.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

BLOCK = 1 << 16
GROUP = 16
NEVER = -(2**62)


# pointers and step functions


def compressed(key_changes: np.ndarray, t: np.ndarray, window: int) -> np.ndarray:
    """Times of one sequence of all keys: a longer gap or another key counts as window + 1, so values stay small and order stays."""
    step = np.empty(len(t), np.int64)
    step[:1] = 0
    step[1:] = np.minimum(t[1:] - t[:-1], window + 1)
    step[key_changes] = window + 1
    step[:1] = 0
    return np.cumsum(step)


def doubled(follow: np.ndarray) -> list[np.ndarray]:
    """The pointer applied 1, 2, 4, .. times, until all have left; a pointer to len(follow) has left."""
    out = [np.append(follow, len(follow))]
    while (out[-1] < len(follow)).any():
        out.append(out[-1][out[-1]])
    return out


def orbit(follow: np.ndarray, start: int) -> np.ndarray:
    """All places that `start` comes to."""
    found = np.array([start], np.int64)
    found = found[found < len(follow)]
    for jump in reversed(doubled(follow)):
        more = jump[found]
        found = np.concatenate([found, more[more < len(follow)]])
    return np.unique(found)


def last_of(follow: np.ndarray) -> np.ndarray:
    """The last place inside that each place comes to."""
    at = np.arange(len(follow))
    for jump in reversed(doubled(follow)):
        more = jump[at]
        at = np.where(more < len(follow), more, at)
    return at


def applied(ends: np.ndarray, values: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A step function: the value of the first end that is not below e, or e beyond the last end."""
    if not len(ends):
        return e
    k = np.searchsorted(ends, e)
    return np.where(k < len(ends), values[np.minimum(k, len(ends) - 1)], e)


def followed(parts: Iterator[tuple[np.ndarray, np.ndarray]], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Step functions one after another as one. A threshold at its begin is less than a window after its first end."""
    ends, values, limit = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for e, v in parts:
        if not len(e):
            continue
        limit = e[0] + window if limit is None else limit
        values = applied(e, v, values)
        if not len(ends) or ends[-1] < limit:
            k = int(np.searchsorted(e, limit)) + 1
            ends, values = np.append(ends, e[:k]), np.append(values, v[:k])
        last = np.append(values[1:] != values[:-1], True)  # of steps to the same value the last one is enough
        ends, values = ends[last], values[last]
    return ends, values


# a task's partition


@dataclass
class Tail:
    """What the partitions behind need to know of one: where it begins and ends, whether a fold starts anew in it, and its last state."""

    part: int
    first_key: str
    first_t: int
    last_key: str
    fresh: bool
    state: object


def ordered(rows: DataFrame) -> DataFrame:
    """`rows` come out of a shuffle, so that the sample for the ranges reads what is dealt already."""
    return rows.repartitionByRange("key", "t", "id").sortWithinPartitions("key", "t", "id")


def without_loose(batches: Iterator[pa.RecordBatch], loose: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with key and time; others go to `loose`."""
    for b in batches:
        out = pc.or_(pc.is_null(b.column("key")), pc.is_null(b.column("t")))
        if pc.any(out).as_py():
            loose.append(b.filter(out))
            b = b.filter(pc.invert(out))
        if b.num_rows:
            yield b


def pieces(batches: Iterator[pa.RecordBatch], largest: int, gap: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, bool]]:
    """(rows, times, places where a fold starts anew, whether all before belongs to the head) in blocks; a block is head or not as a whole."""
    key, last, head = None, 0, True
    for whole in batches:
        for lo in range(0, whole.num_rows, largest):
            b = whole.slice(lo, largest)
            t = b.column("t").to_numpy()
            keys = b.column("key").dictionary_encode()
            codes = keys.indices.to_numpy()
            new = np.zeros(len(t), bool)
            new[1:] = (codes[1:] != codes[:-1]) | (t[1:] - t[:-1] >= gap)
            new[0] = key is not None and (keys.dictionary[codes[0]].as_py() != key or t[0] - last >= gap)
            key, last = keys.dictionary[codes[-1]].as_py(), t[-1]
            starts = np.flatnonzero(new)
            if head and len(starts):
                if starts[0]:
                    yield b.slice(0, starts[0]), t[: starts[0]], starts[:0], True
                head = False
                b, t, starts = b.slice(starts[0]), t[starts[0] :], starts - starts[0]
            yield b, t, starts, head


def linked(tails: list[Tail], gap: int, reach: Callable[[Tail], int]) -> dict[int, int]:
    """For each partition whose head goes on where another one ended: that other one. `reach` is the last time that a final state knows."""
    out = {}
    tails = sorted(tails, key=lambda x: x.part)
    for a, b in zip(tails[:-1], tails[1:], strict=True):
        if a.last_key == b.first_key and (not a.fresh or b.first_t - reach(a) < gap):
            out[b.part] = a.part
    return out


# accepted rows a window apart


def _spaced_survey(window: int, largest: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = last_key = None
        head_steps, threshold, fresh, steps_of_head = [], NEVER, False, None
        ends = values = np.zeros(0, np.int64)

        def out(kind: str, n: int, **c: object) -> pa.RecordBatch:
            fill = {"key": pa.string(), "t": pa.int64(), "id": pa.int64(), "value": pa.int64(), "text": pa.string()}
            return pa.record_batch([pa.array([kind] * n, pa.string()), pa.array([part] * n, pa.int32()), *[c.get(k, pa.nulls(n, v)) for k, v in fill.items()]], ["kind", "part", *fill])

        loose: list[pa.RecordBatch] = []
        for b, t, starts, head in pieces(without_loose(batches, loose), largest, window):
            keys = b.column("key")
            first = first or (keys[0].as_py(), int(t[0]))
            last_key = keys[-1].as_py()
            v = compressed(starts, t, window)
            follow = np.searchsorted(v, v + window)
            if head:
                exits = t[last_of(follow)] + window
                ends, values = followed([(ends, values), (t, exits)], window) if len(ends) else followed([(t, exits)], window)
                yield out("head", len(t), key=keys, t=b.column("t"), id=b.column("id"))
                continue
            fresh = True
            # what the blocks before allow: the first row at or after the threshold, or the first new start
            begin = 0 if len(starts) and starts[0] == 0 else int(min(np.searchsorted(t[: starts[0]] if len(starts) else t, threshold), starts[0] if len(starts) else len(t)))
            taken = orbit(follow, begin)
            if len(taken):
                threshold = int(t[taken[-1]]) + window
            elif len(starts):
                threshold = NEVER
            yield out("row", len(taken), key=keys.take(pa.array(taken)), t=b.column("t").take(pa.array(taken)), id=b.column("id").take(pa.array(taken)))
        for b in loose:
            yield out("row", b.num_rows, key=b.column("key"), t=b.column("t"), id=b.column("id"))
        if first:
            yield out("tail", 1, key=pa.array([first[0]]), t=pa.array([first[1]]), value=pa.array([threshold if fresh else None], pa.int64()), text=pa.array([last_key]))
            if not fresh:
                yield out("step", len(ends), t=pa.array(ends), value=pa.array(values))

    return run


def _compose(window: int) -> Callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["nth", "t"])
        ends, values = followed(((g["t"].to_numpy(), g["value"].to_numpy()) for _, g in rows.groupby("nth", sort=True)), window)
        return pd.DataFrame({"chain": rows["chain"].iloc[0], "nth": rows["nth"].iloc[0] // GROUP, "t": ends, "value": values})

    return run


def _hand_down() -> Callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["nth", "t"])
        e, out = np.array([rows["begin"].iloc[0]]), []
        for nth, g in rows.groupby("nth", sort=True):
            out.append((rows["chain"].iloc[0], nth, int(e[0])))
            e = applied(g["t"].to_numpy(), g["value"].to_numpy(), e)
        return pd.DataFrame([*out, (rows["chain"].iloc[0], int(rows["nth"].iloc[-1]) + 1, int(e[0]))], columns=["chain", "nth", "begin"])

    return run


def thresholds(tails: list[Tail], steps: DataFrame, window: int) -> dict[int, int]:
    """The threshold at the begin of each partition that needs one. Chains of heads without a new start are composed; others are known at once."""
    before = linked(tails, window, lambda x: x.state - window)
    state = {x.part: x.state for x in tails}
    known = {p: state[q] for p, q in before.items() if state[q] is not None}
    chains: list[list[int]] = []
    place: dict[int, tuple[int, int]] = {}
    for x in sorted(tails, key=lambda x: x.part):  # a head without a new start goes on a chain or begins one
        if x.state is None:
            q = before.get(x.part)
            if q in place:
                place[x.part] = (place[q][0], place[q][1] + 1)
                chains[place[q][0]].append(x.part)
            else:
                place[x.part] = (len(chains), 0)
                chains.append([x.part])
    after = {q: p for p, q in before.items()}
    chains_used = [c for c, parts in enumerate(chains) if len(parts) > 1 or parts[-1] in after]
    if not chains_used:
        return known
    spark = steps.sparkSession
    where = spark.createDataFrame([(p, *place[p]) for c in chains_used for p in chains[c]], "part int, chain int, nth int")  # a row a partition
    level = steps.join(F.broadcast(where), "part").select("chain", "nth", "t", "value")
    longest, levels = max(len(chains[c]) for c in chains_used), []
    while longest > GROUP:
        levels.append(level)
        level = stored(level.groupBy("chain", F.floor(F.col("nth") / GROUP)).applyInPandas(_compose(window), "chain int, nth int, t long, value long"))
        longest = -(-longest // GROUP)
    begin = spark.createDataFrame([(c, known.get(chains[c][0], NEVER)) for c in chains_used], "chain int, begin long")
    entries = level.join(F.broadcast(begin), "chain").groupBy("chain").applyInPandas(_hand_down(), "chain int, nth int, begin long")
    for finer in reversed(levels):
        some = entries.withColumnRenamed("nth", "group")
        entries = finer.withColumn("group", F.floor(F.col("nth") / GROUP).cast("int")).join(some, ["chain", "group"]).groupBy("chain", "group").applyInPandas(_hand_down(), "chain int, nth int, begin long")
    for r in entries.collect():  # about a row a partition
        parts = chains[r["chain"]]
        if r["nth"] < len(parts):
            known[parts[r["nth"]]] = r["begin"]
        elif r["nth"] == len(parts) and parts[-1] in after:
            known[after[parts[-1]]] = r["begin"]
    return known


def _mark(begin: dict[int, int], window: int, largest: int) -> Callable:
    """The accepted rows of heads, sorted by partition and time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, threshold = None, NEVER
        for whole in batches:
            for lo in range(0, whole.num_rows, largest):
                b = whole.slice(lo, largest)
                parts, t = b.column("part").to_numpy(), b.column("t").to_numpy()
                for a in np.unique(parts).tolist():
                    if a != part:
                        part, threshold = a, begin.get(a, NEVER)
                    i, j = np.searchsorted(parts, [a, a + 1])
                    times = t[i:j]
                    taken = orbit(np.searchsorted(times, times + window), int(np.searchsorted(times, threshold)))
                    if len(taken):
                        threshold = int(times[taken[-1]]) + window
                        yield pa.record_batch([b.column(c).take(pa.array(taken + i)) for c in ("key", "id", "t")], ["key", "id", "t"])

    return run


def spaced(rows: DataFrame, window_us: int, largest: int = BLOCK) -> DataFrame:
    """(key, id, t) of the accepted ones of rows (key, t, id): in the order of t and id, a row at least the window after the last accepted one of its key."""
    rows = rows.select("key", F.col("t").cast("long").alias("t"), F.col("id").cast("long").alias("id"))
    if window_us <= 0:
        return rows.select("key", "id", "t")
    largest = max(1, min(largest, 2**61 // (window_us + 1)))
    # of the rows of one time the first one stands for all, but for those without key or time
    loose = F.when(F.col("key").isNull() | F.col("t").isNull(), F.col("id"))
    times = ordered(rows.groupBy("key", "t", loose.alias("loose")).agg(F.min("id").alias("id")).drop("loose"))
    found = stored(times.mapInArrow(_spaced_survey(window_us, largest), "kind string, part int, key string, t long, id long, value long, text string"), "kind")
    tails = [Tail(r["part"], r["key"], r["t"], r["text"], r["value"] is not None, r["value"]) for r in found.where("kind = 'tail'").collect()]  # a row a partition
    begin = thresholds(tails, found.where("kind = 'step'").select("part", "t", "value"), window_us)
    heads = found.where("kind = 'head'").select("part", "key", "t", "id").repartition("part").sortWithinPartitions("part", "t")
    marked = heads.mapInArrow(_mark(begin, window_us, largest), "key string, id long, t long")
    return found.where("kind = 'row'").select("key", "id", "t").unionByName(marked)


# cooldown and duplicates


@dataclass
class Gate:
    """What one key remembers: the time of the last dispatch, and the jobs dispatched within the horizon, oldest first."""

    window_us: int
    horizon_us: int = 0
    last: int | None = None
    live: dict[str, int] = field(default_factory=dict)

    def __call__(self, t: int, job: str | None = None) -> str:
        """The cooldown is looked at before the duplicate, and only a dispatched job moves it."""
        if self.last is not None and t - self.last < self.window_us:
            return "cooldown"
        if job is not None and job in self.live:
            if t - self.live[job] < self.horizon_us:
                return "duplicate"
            del self.live[job]
        self.last = t
        if job is not None:
            self.live[job] = t
            self.forget(t)
        return "dispatched"

    def forget(self, t: int) -> None:
        while self.live and t - next(iter(self.live.values())) >= self.horizon_us:
            del self.live[next(iter(self.live))]

    def state(self, t: int) -> tuple:
        """What matters for rows from t on."""
        self.forget(t)
        return (self.last if self.last is not None and t - self.last < self.window_us else None, tuple(self.live.items()))


def _through(gate: Gate, t: list[int], jobs: list[str | None], out: list[str], lo: int, hi: int) -> None:
    """Outcomes of rows lo to hi, one step for each row that isn't cooling."""
    i = lo
    while i < hi:
        if gate.last is not None and t[i] - gate.last < gate.window_us:
            i = bisect.bisect_left(t, gate.last + gate.window_us, i, hi)
            continue
        out[i] = gate(t[i], jobs[i])
        i += 1


def _gated_survey(window: int, horizon: int, largest: int) -> Callable:
    gap = max(window, horizon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last_key, fresh, gate, t = TaskContext.get().partitionId(), None, None, False, Gate(window, horizon), np.zeros(0)
        loose: list[pa.RecordBatch] = []

        def rows(kind: str, b: pa.RecordBatch, outcomes: list[str]) -> pa.RecordBatch:
            n = len(outcomes)
            return pa.record_batch(
                [pa.array([kind] * n, pa.string()), pa.array([part] * n, pa.int32()), *[b.column(c) for c in ("key", "t", "id", "job")], pa.array(outcomes, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, LIVE)],
                ["kind", "part", "key", "t", "id", "job", "outcome", "last", "live"],
            )

        for b, t, starts, head in pieces(without_loose(batches, loose), largest, gap):
            first = first or (b.column("key")[0].as_py(), int(t[0]))
            last_key = b.column("key")[-1].as_py()
            fresh = fresh or not head
            times, jobs, out = t.tolist(), b.column("job").to_pylist(), ["cooldown"] * len(t)
            bounds = [0, *starts.tolist(), len(t)]
            for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if k:
                    gate = Gate(window, horizon)
                _through(gate, times, jobs, out, lo, hi)
            yield rows("head" if head else "row", b, out)
        for b in loose:
            yield rows("row", b, ["dispatched"] * b.num_rows)
        if first:
            yield pa.record_batch(
                [pa.array(["tail"]), pa.array([part], pa.int32()), pa.array([first[0]]), pa.array([first[1]]), pa.array([int(fresh)]), pa.array([last_key]), pa.nulls(1, pa.string()), pa.array([gate.last], pa.int64()), pa.array([list(gate.live.items())], LIVE)],
                ["kind", "part", "key", "t", "id", "job", "outcome", "last", "live"],
            )

    return run


LIVE = pa.map_(pa.string(), pa.int64())


def _again(begin: dict[int, tuple], window: int, horizon: int, tails_only: bool) -> Callable:
    """Heads run from the gates before them, beside one from an empty gate, until both are alike; then the outcomes already found hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, true, empty, rerun, met = None, None, None, 0, False

        def tail() -> pa.RecordBatch:
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([true.last], pa.int64()), pa.array([list(true.live.items())], LIVE), pa.array([met])], ["part", "last", "live", "met"])

        for b in batches:
            parts, times, jobs, found = (b.column(c).to_pylist() for c in ("part", "t", "job", "outcome"))
            again = [False] * len(parts)
            for i, (p, t) in enumerate(zip(parts, times, strict=True)):
                if p != part:
                    if tails_only and part is not None:
                        yield tail()
                    last, live = begin[p]
                    part, met, rerun = p, False, 0
                    true, empty = Gate(window, horizon, last, dict(live)), Gate(window, horizon)
                if met or ((not rerun or empty.last == true.last) and empty.state(t) == true.state(t)):
                    met = True
                    continue
                found[i] = true(t, jobs[i])
                empty(t, jobs[i])
                again[i] = True
                rerun += 1
            if not tails_only:
                yield pa.record_batch([b.column("key"), b.column("id"), b.column("t"), pa.array(found, pa.string()), pa.array(again)], ["key", "id", "t", "outcome", "rerun"])
        if tails_only and part is not None:
            yield tail()

    return run


def gated(rows: DataFrame, window_us: int, horizon_us: int, largest: int = BLOCK) -> DataFrame:
    """(key, id, t, outcome, rerun) of rows (key, t, id, job): dispatched, cooldown or duplicate; rerun says that a row was run a second time."""
    rows = rows.select("key", F.col("t").cast("long").alias("t"), F.col("id").cast("long").alias("id"), "job")
    schema = "kind string, part int, key string, t long, id long, job string, outcome string, last long, live map<string,long>"
    dealt = rows.repartition("key", "t", "id")
    found = stored(ordered(dealt).mapInArrow(_gated_survey(window_us, horizon_us, largest), schema), "kind")
    gap = max(window_us, horizon_us)
    tails = {r["part"]: Tail(r["part"], r["key"], r["t"], r["job"], bool(r["id"]), (r["last"], tuple((r["live"] or {}).items()))) for r in found.where("kind = 'tail'").collect()}  # a row a partition
    before = linked(list(tails.values()), gap, lambda x: NEVER if x.state[0] is None else x.state[0])
    heads = found.where("kind = 'head'").select("part", "key", "t", "id", "job", "outcome")

    def of(parts: list[int]) -> DataFrame:
        return heads.where(F.col("part").isin(parts)).repartition("part").sortWithinPartitions("part", "t", "id")

    begin: dict[int, tuple] = {}
    from_empty = {p: x.state for p, x in tails.items()}
    todo = sorted(before)
    while todo:
        begin.update({p: tails[before[p]].state for p in todo})
        changed = set()
        for r in of(todo).mapInArrow(_again({p: begin[p] for p in todo}, window_us, horizon_us, True), "part int, last long, live map<string,long>, met boolean").collect():
            x = tails[r["part"]]
            state = from_empty[r["part"]] if r["met"] else (r["last"], tuple((r["live"] or {}).items()))
            if not x.fresh and state != x.state:
                x.state = state
                changed.add(x.part)
        todo = sorted(p for p, q in before.items() if q in changed)
    some = sorted(begin)
    sure = found.where((F.col("kind") == "row") | ((F.col("kind") == "head") & ~F.col("part").isin(some))).select("key", "id", "t", "outcome", F.lit(False).alias("rerun"))
    return sure.unionByName(of(some).mapInArrow(_again(begin, window_us, horizon_us, False), "key string, id long, t long, outcome string, rerun boolean"))

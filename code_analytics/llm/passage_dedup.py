"""Repeated lines and sentences: hash the units, keep the earliest occurrence, remove the others.

A unit is a line of at least MIN_WORDS words, or a run of sentences within a line that just reaches MIN_WORDS: from every
sentence on, and up to every sentence. A long sentence is a unit by itself; a short one is hashed together with its
neighbours, so that a repeated passage of short sentences goes too. Units are normalised to their lower-cased words.
The digests of all units are grouped, and every unit after the earliest (by document id, then place) goes. Removed
pieces are the maximal runs of characters that such units cover, with their offsets in the original text, the number of
their units, and the smallest document that keeps one of them.

The digests of units that occur once never reach the join. The earliest place of a digest is found by partial
aggregation, and the join of places to it is one that Spark may split at a hot digest.

Nulls: a null text has no units; a document without id counts as larger than all others. Rows with the same id and
text count as one: neither removes the other's units. Ties go by document id and place. A very long text is cut into units
inside its task. Columns beside doc_id and text are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernels import signed, sliced, stored, table
from .units import Units, column, keyed

MIN_WORDS = 8
UNITS = "d1 long, d2 long, ord long, k binary, start int, length int"


def sentence_runs(u: Units, min_words: int) -> None:
    """Turns the sentences of `u` into the units: whole lines, and runs of sentences that just reach min_words."""
    if not len(u.first):
        return
    first, stop = u.first, u.stop
    group = np.cumsum((np.diff(u.row, prepend=-1) != 0) | (np.diff(u.line, prepend=-1) != 0))
    here = np.arange(len(first))
    until = np.searchsorted(stop, first + min_words)  # the sentence that ends a run from here on
    since = np.searchsorted(first, stop - min_words, "right") - 1  # the sentence that begins a run up to here
    on, back = until < len(first), since >= 0
    on[on], back[back] = group[until[on]] == group[on], group[since[back]] == group[back]
    begin = np.flatnonzero(np.diff(group, prepend=0))
    end = np.append(begin[1:], len(first)) - 1
    spans = np.concatenate([np.stack([first[here[on]], stop[until[on]]]), np.stack([first[since[back]], stop[here[back]]]), np.stack([first[begin], stop[end]])], axis=1)
    u.first, u.stop = np.unique(spans[:, spans[1] - spans[0] >= min_words], axis=1)


def passage_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in sliced(batches):
            u = Units(data, at, sentences=True)
            sentence_runs(u, min_words)
            d1, d2 = u.digests()
            start, length = u.chars()
            take = pa.array(u.row)
            ints = [pa.array(v.astype(np.int32)) for v in (start, length)]
            yield pa.record_batch([pa.array(signed(d1)), pa.array(signed(d2)), column(rows, "ord").take(take), column(rows, "k").take(take), *ints], ["d1", "d2", "ord", "k", "start", "length"])

    return keyed(docs).mapInArrow(run, UNITS)


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """ord, k, start, length, first_ord of each unit that goes."""
    units = passage_units(docs, min_words)
    place = F.struct("ord", "start", "k")
    first = units.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("d1", "d2", "first")
    first = stored(first)
    out = units.join(first, ["d1", "d2"]).where(F.struct("ord", "start") > F.struct(F.col("first.ord"), F.col("first.start")))
    return out.select("ord", "k", "start", "length", F.col("first.ord").alias("first_ord"))


def removed_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """ord, k, start, length, units, first_ord: the maximal runs of characters that go."""
    w = Window.partitionBy("ord", "k").orderBy("start", "length")
    units = repeated_units(docs, min_words).withColumn("stop", F.col("start") + F.col("length"))
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    units = units.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1))
    runs = units.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("ord", "k", "run")
    out = runs.agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("units"), F.min("first_ord").alias("first_ord"))
    return out.select("ord", "k", "start", (F.col("stop") - F.col("start")).alias("length"), "units", "first_ord")


def op6_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each removed run of `documents`, by units of at least eight words."""
    none = F.lit(2**63 - 1)
    out = removed_runs(table(spark, sf_dir, "documents"), MIN_WORDS)
    return out.select(
        F.nullif("ord", none).alias("doc_id"), F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), "units", F.nullif("first_ord", none).alias("first_doc_id")
    )


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, the text that remains, and the removed spans (start, length in characters of the original)."""
    gone = removed_runs(docs, min_words).groupBy("ord", "k").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("removed"))
    texts = keyed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).join(gone, ["ord", "k"], "left")
    removed = F.coalesce("removed", F.array().cast("array<struct<start:int,length:int>>"))
    stop = lambda x: x["start"] + x["length"]
    begins = F.concat(F.array(F.lit(0)), F.transform(removed, stop))
    ends = F.concat(F.transform(removed, lambda x: x["start"]), F.array(F.length("text")))
    kept = F.array_join(F.zip_with(begins, ends, lambda a, b: F.substring("text", a + 1, b - a)), "")
    return texts.select(F.nullif("ord", F.lit(2**63 - 1)).alias("doc_id"), kept.alias("text"), "removed")


ORACLE = r"""
with lines as (select doc_id, unnest(range(0, len(l))) as li, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)),
lb as (select doc_id, li, line, coalesce(sum(length(line)+1) over (partition by doc_id order by li rows between unbounded preceding and 1 preceding),0) as base from lines),
w as (select doc_id, li, base, line, regexp_extract_all(line, '[^ \t\n\x0B\f\r]+') as ws, regexp_extract_all(line, '[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+') as raw from lb),
x as (select doc_id, li, base, unnest(range(0, len(ws))) as wi, unnest(ws) as word, unnest(raw) as r from w),
p as (select doc_id, li, base, wi, word, base + sum(length(r)) over (partition by doc_id, li order by wi) as stop,
   coalesce(sum(case when regexp_matches(word, '[.!?]$') then 1 else 0 end) over (partition by doc_id, li order by wi rows between unbounded preceding and 1 preceding),0) as sn from x),
v as (select doc_id, li, sn, count(*) as n, min(stop - length(word)) as start, max(stop) as stop from p group by doc_id, li, sn),
s as (select *, sum(n) over (partition by doc_id, li order by sn) as upto from v),
t as (select doc_id, li, list_transform(ws, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as ws from w),
fw as (select a.doc_id, a.li, a.upto - a.n as lo, min(b.upto) as hi, a.start, min(b.stop) as stop from s a join s b on a.doc_id=b.doc_id and a.li=b.li and b.sn>=a.sn and b.upto-(a.upto-a.n)>=8 group by a.doc_id, a.li, a.upto, a.n, a.start),
bw as (select b.doc_id, b.li, max(a.upto-a.n) as lo, b.upto as hi, max(a.start) as start, b.stop from s a join s b on a.doc_id=b.doc_id and a.li=b.li and b.sn>=a.sn and b.upto-(a.upto-a.n)>=8 group by b.doc_id, b.li, b.upto, b.stop),
ln as (select doc_id, li, 0 as lo, max(upto) as hi, min(start) as start, max(stop) as stop from s group by doc_id, li having max(upto) >= 8),
u as (select distinct x.doc_id, x.start, x.stop, array_to_string(t.ws[cast(x.lo as bigint)+1:cast(x.hi as bigint)],' ') as unit from (select * from fw union select * from bw union select * from ln) x join t on t.doc_id=x.doc_id and t.li=x.li),
f as (select *, first_value(doc_id) over q as fd, first_value(start) over q as fs from u window q as (partition by unit order by doc_id, start)),
g as (select doc_id, start, stop, fd from f where doc_id > fd or (doc_id = fd and start > fs)),
h as (select *, case when start <= max(stop) over (partition by doc_id order by start, stop rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from g),
r as (select *, sum(fresh) over (partition by doc_id order by start, stop rows between unbounded preceding and current row) as run from h)
select doc_id, cast(min(start) as bigint) as start, cast(max(stop)-min(start) as bigint) as length, count(*) as units, min(fd) as first_doc_id from r group by doc_id, run
"""

"""Near-duplicate lines by deletion neighbourhoods.

Two lines (with a word, lower-cased, white space ignored) match if one becomes the other by at
most one word put in, left out or exchanged and the longer has at least near_words words; other lines match only if
equal, whatever their length. A line goes if an earlier line (by document id, then line number) matches it, whether or not that one stays.

1. Equal lines are one class, known by the place of its earliest line.
2. A class is a candidate if it shares its first or its last half with another: one edit leaves a half alone, so
   classes whose halves occur nowhere else need no neighbourhood.
3. A candidate emits two 64-bit digests of itself and of each variant with one word left out, together with the place of
   that word. Equal variants with the same place differ in one exchanged word; a variant that equals a whole line
   differs by one left out. The earliest line of a key is found by partial aggregation and joined back, so there are no
   pairs within a key, and a template line with one changing word, however frequent, is a key that a join may split.
4. The words of each match are compared, then every occurrence of a matched class goes, and of the others
   every one but the earliest.

Nulls: a null text has no lines; a document without id counts as larger than all others. Rows with the same id and
text count as one and are treated alike. Ties go by document id and then line. A very long text is cut into lines inside its
task. An empty table gives an empty result. Columns beside doc_id and text may
have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import U, mix, powers, signed, sliced, stored, table
from .units import Units, column, key_of, keyed, ord_of, second

#: least words of the longer line for an edit to count: one word in eight
NEAR_WORDS = 8
LINES = "c1 long, c2 long, ord long, k binary, line int, n int, halves array<long>"


def _span_sums(codes: np.ndarray) -> np.ndarray:
    up, _ = powers(len(codes))
    total = np.zeros(len(codes) + 1, U)
    np.cumsum(codes * up[: len(codes)], out=total[1:])
    return total


def halves(u: Units, near_words: int = NEAR_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the halves that one edit may leave alone, and their number for each line.

    A line of n words meets lines of n - 1, n and n + 1 words; the half is that of the shorter of the two.
    """
    n = u.n_words
    total = _span_sums(u.codes)
    _, down = powers(len(u.codes))
    keys, owner = [], []
    for odd in (0, 1):
        m = (n - odd) // 2
        use = (n >= near_words - 1) & ((odd == 0) | (n % 2 == 0))
        f, s, m = u.first[use], u.stop[use], m[use]
        for side, (lo, hi) in enumerate(((f, f + m), (s - m, s))):
            keys.append(mix((total[hi] - total[lo]) * down[lo] + mix((m * 2 + side).astype(U) + U(99))))
            owner.append(np.flatnonzero(use))
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return keys[order], np.bincount(owner, minlength=len(n))


def all_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in sliced(batches):
            u = Units(data, at)
            u.pick(u.n_words > 0)
            c1, c2 = u.digests()
            keys, counts = halves(u, near_words)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(signed(keys)))
            take = pa.array(u.row)
            yield pa.record_batch(
                [pa.array(signed(c1)), pa.array(signed(c2)), column(rows, "ord").take(take), column(rows, "k").take(take), pa.array(u.line.astype(np.int32)), pa.array(u.n_words.astype(np.int32)), lists],
                ["c1", "c2", "ord", "k", "line", "n", "halves"],
            )

    return keyed(docs).mapInArrow(run, LINES)


def wanted_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each line that is listed in `lines`, with its digests and place."""
    for rows, data, at in sliced(batches):
        u = Units(data, at)
        want = column(rows, "lines")
        wanted_row = np.repeat(np.arange(len(want)), want.value_lengths().to_numpy(zero_copy_only=False))
        u.pick(np.isin(u.row * (1 << 32) + u.line, wanted_row * (1 << 32) + want.flatten().to_numpy(zero_copy_only=False)))
        c1, c2 = u.digests()
        spans = zip(u.starts[u.first].tolist(), u.ends[u.stop - 1].tolist(), strict=True) if len(u.first) else ()
        texts = [data[lo:hi].tobytes().decode("utf-8") for lo, hi in spans]
        yield pa.record_batch([pa.array(signed(c1)), pa.array(signed(c2)), column(rows, "ord").take(pa.array(u.row)), pa.array(u.line.astype(np.int32)), pa.array(texts, pa.string())], ["c1", "c2", "ord", "line", "text"])


VARIANTS = "v1 long, v2 long, pos int, ord long, line int, c1 long, c2 long"


def variants(batches: Iterator[pa.RecordBatch], near_words: int = NEAR_WORDS) -> Iterator[pa.RecordBatch]:
    """Each line whole (pos -1) and with one word left out."""
    for rows, data, at in sliced(batches):
        u = Units(data, at)
        c1, c2 = (column(rows, c).to_numpy() for c in ("c1", "c2"))
        n = u.n_words
        _, down = powers(len(u.codes))
        shorter = np.where(n >= near_words, n, 0)
        line = np.repeat(np.arange(len(n)), shorter)
        place = np.arange(len(line)) - np.repeat(np.cumsum(shorter) - shorter, shorter)
        w = u.first[line] + place
        keys = []
        for whole, codes in ((c1, u.codes), (c2, second(u.codes))):
            total = _span_sums(codes)
            before = total[w] - total[u.first[line]]
            after = (total[u.stop[line]] - total[w + 1]) * down[1]
            v = mix((before + after) * down[u.first[line]] + (n[line] - 1).astype(U))
            keys.append(pa.array(np.concatenate([whole, signed(v)])))
        both = np.concatenate([np.arange(len(n)), line])
        yield pa.record_batch(
            [*keys, pa.array(np.concatenate([np.full(len(n), -1), place]).astype(np.int32)), *(column(rows, c).take(pa.array(both)) for c in ("ord", "line", "c1", "c2"))],
            ["v1", "v2", "pos", "ord", "line", "c1", "c2"],
        )


#: bytes of lists of lines up to which they are sent to the texts rather than both shuffled
BROADCAST_BYTES = 32 << 20


def few(lists: DataFrame, entries: str | None = None) -> DataFrame:
    """`lists` stored, with a broadcast hint while it is small: 64 bytes are reckoned for a row and 16 for each entry of the array `entries`."""
    lists = stored(lists)
    n, more = lists.agg(F.count("*"), F.coalesce(F.sum(F.size(entries)), F.lit(0)) if entries else F.lit(0)).first()
    return F.broadcast(lists) if 64 * n + 16 * more <= BROADCAST_BYTES else lists


def _without(words: str, pos: str):
    """The array of words less the one at `pos`, or whole where pos is -1."""
    w, p = F.col(words), F.col(pos)
    return F.when(p < 0, w).otherwise(F.concat(F.slice(w, F.lit(1), p), F.slice(w, p + 2, F.size(w))))


def matches(texts: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """(c1, c2, p_ord, p_line): lines of `texts` and earlier ones that one edit makes of them.

    The earliest line of every variant and place is found by partial aggregation, and the lines of the few variants that
    several hold are joined to it, so a variant that a third of all lines share is only a key that a join may split.
    """
    v = texts.select("c1", "c2", "ord", "line", "text").mapInArrow(lambda batches: variants(batches, near_words), VARIANTS)
    here = F.struct("ord", "line")
    heads = stored(v.groupBy("v1", "v2", "pos").agg(F.min(here).alias("head"), F.max(here).alias("tail")))
    by_v = heads.groupBy("v1", "v2").agg(
        F.min(F.when(F.col("pos") < 0, F.col("head"))).alias("whole"), F.min(F.when(F.col("pos") >= 0, F.struct("head.ord", "head.line", "pos"))).alias("least"),
        F.max(F.when(F.col("pos") >= 0, F.col("tail"))).alias("tail"),
    )
    # an exchanged word: lines with a word left out at the same place, of which the earliest is the other line
    same = heads.where("pos >= 0 and head <> tail").select("v1", "v2", "pos", F.col("head").alias("p"), F.col("pos").alias("p_pos"))
    # a word put in or left out: a whole line, and a line that makes it with one word less
    longer = by_v.where("whole is not null and tail > whole").select("v1", "v2", F.col("whole").alias("p"), F.lit(-1).alias("p_pos"))
    shorter = by_v.where("whole is not null and struct(least.ord, least.line) < whole").select("v1", "v2", F.lit(-1).alias("pos"), F.struct("least.ord", "least.line").alias("p"), F.col("least.pos").alias("p_pos"))
    rows = v.select("v1", "v2", "pos", "c1", "c2", here.alias("me"))
    found = rows.join(same, ["v1", "v2", "pos"]).select("c1", "c2", "me", "pos", "p", "p_pos")
    found = found.union(rows.where("pos >= 0").join(longer, ["v1", "v2"]).select("c1", "c2", "me", "pos", "p", "p_pos"))
    found = found.union(rows.where("pos < 0").join(shorter, ["v1", "v2", "pos"]).select("c1", "c2", "me", "pos", "p", "p_pos"))
    found = found.where("p < me").select("c1", "c2", F.col("p.ord").alias("p_ord"), F.col("p.line").alias("p_line"), "pos", "p_pos").distinct()
    words = F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[\\x20\\x09-\\x0D]+")
    known = stored(texts.select("c1", "c2", "ord", "line", words.alias("words")))
    pairs = found.join(known.select("c1", "c2", "words"), ["c1", "c2"]).join(known.select(F.col("ord").alias("p_ord"), F.col("line").alias("p_line"), F.col("words").alias("p_words")), ["p_ord", "p_line"])
    # digests found them; the words decide
    return pairs.where(_without("words", "pos") == _without("p_words", "p_pos")).select("c1", "c2", "p_ord", "p_line")


def removed_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """ord, k, line, first_ord, first_line, edits of each line that goes; edits is 0 for an equal line.

    near_words: least words of the longer line for an edit to count; equal lines go whatever their length.
    """
    lines = all_lines(docs, near_words)
    classes = stored(
        lines.groupBy("c1", "c2").agg(F.min(F.struct("ord", "line", "k")).alias("first"), F.max(F.struct("ord", "line", "k")).alias("last"), F.first("halves").alias("halves"))
    )
    by_half = classes.select(F.explode("halves").alias("h"), "c1", "c2", "first")
    shared = by_half.groupBy("h").agg(F.min("c1").alias("lo"), F.max("c1").alias("hi")).where("lo <> hi").select("h")
    candidates = stored(by_half.join(shared, "h").select("c1", "c2", "first").distinct())
    wanted = candidates.groupBy(F.col("first.ord").alias("ord"), F.col("first.k").alias("k")).agg(F.collect_set("first.line").alias("lines"))
    texts = keyed(docs).join(few(wanted, "lines"), ["ord", "k"]).mapInArrow(wanted_lines, "c1 long, c2 long, ord long, line int, text string")
    texts = stored(texts.dropDuplicates(["ord", "line", "c1", "c2"]))
    near = matches(texts, near_words).groupBy("c1", "c2").agg(F.min(F.struct("p_ord", "p_line")).alias("near"))
    gone = stored(classes.join(near, ["c1", "c2"], "left").where("near is not null or first <> last").select("c1", "c2", "first", "near"))
    hit = lines.select("c1", "c2", "ord", "k", "line").join(gone, ["c1", "c2"])
    later = F.struct("ord", "line") > F.struct(F.col("first.ord"), F.col("first.line"))
    equal = hit.where(later).select("ord", "k", "line", F.col("first.ord").alias("first_ord"), F.col("first.line").alias("first_line"), F.lit(0).alias("edits"))
    changed = hit.where(~later & F.col("near").isNotNull()).select("ord", "k", "line", F.col("near.p_ord").alias("first_ord"), F.col("near.p_line").alias("first_line"), F.lit(1).alias("edits"))
    return equal.union(changed)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line of `documents` that goes."""
    none = F.lit(2**63 - 1)
    out = removed_lines(table(spark, sf_dir, "documents"))
    return out.select(
        F.nullif("ord", none).alias("doc_id"), F.col("line").cast("long").alias("line"), F.nullif("first_ord", none).alias("first_doc_id"), F.col("first_line").cast("long").alias("first_line"), "edits"
    )


def without_repeats(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """All rows and columns of `docs`; from `text` the lines that go are left out, and n_chars, if there, follows."""
    gone = removed_lines(docs, near_words).groupBy("ord", "k").agg(F.collect_set("line").alias("_gone"))
    whole = docs.select(ord_of().alias("_ord"), key_of().alias("_k"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    joined = whole.join(few(gone, "_gone"), (F.col("_ord") == F.col("ord")) & (F.col("_k") == F.col("k")), "left")
    rest = F.array_join(F.filter(F.split("_row.text", "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    text = F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(rest)
    cols = []
    for c in docs.columns:
        old = F.col(f"_row.`{c}`")
        kind = docs.schema[c].dataType
        cols.append((text if c == "text" else F.when(F.col("_gone").isNull(), old).otherwise(F.length(rest).cast(kind)) if c == "n_chars" else old).alias(c))
    return joined.select(*cols)

"""Packing by minimum bin slack.

Texts are turned into token ids and cut into pieces of at most `capacity` ids; what is left of a text after its full
pieces is a remainder. Only the number of pieces of each length matters for a plan, so the plan is made from a table
of at most `capacity` rows: the largest remaining length opens a window, a subset-sum program over bitsets finds the
multiset of remaining lengths that fills the rest closest to capacity, the counts are read back from the bitsets,
and the pattern is used as often as the counts allow. Every pattern application uses up a length or leaves it with fewer
pieces than the pattern needs, so there are about as many patterns as lengths, whatever the number of texts.

Pieces find their place by their rank among the pieces of their length. Ranks are counted inside small groups and
shifted by the totals of the groups before, so that no task holds all pieces of a common length.

Nulls: a null text is packed as an empty one (the end id alone); a null doc_id stays null. Repeated rows are packed
each, and pieces equal in length and rank are placed in the order of their keys. The string of a special token in a text is
that token, as the tokenizer file has it. A very long text is encoded whole in its task and cut into full pieces. Columns
beside doc_id and text are ignored, whatever their names. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Encoder
from .kernels import sliced, stored, table

CAPACITY = 1024
END_ID = 0
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most `capacity` ids of each text and its end id, each id in one piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for rows, data, at in sliced(batches):
            ids, upto = enc.encode(data, at)
            tokens = np.diff(upto) + 1
            n = -(-tokens // capacity)
            row = np.repeat(np.arange(len(n)), n)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * capacity
            length = np.minimum(capacity, tokens[row] - start)
            end = np.array([END_ID], "<u4").tobytes()
            raw = ids.astype("<u4", copy=False)
            crc = []
            for r, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True):
                lo = int(upto[r]) + s
                last = s + k == tokens[r]
                c = zlib.crc32(raw[lo : lo + k - last].tobytes())
                crc.append(zlib.crc32(end, c) if last else c)
            yield pa.record_batch(
                [rows.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens[row])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def closest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length fill `room` most closely: subset sums as bits, then the counts read back."""
    reach, steps = 1, []
    full = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        steps.append((length, reach))
        grown = reach
        for _ in range(min(counts[length], room // length)):
            more = (grown << length | reach) & full
            if more == grown:
                break
            grown = more
        reach = grown
        if reach >> room & 1:
            break
    left, used = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        k = 0
        while not before >> (left - k * length) & 1:
            k += 1
        if k:
            used[length] = k
            left -= k * length
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, pattern) until no piece is left; a pattern says how many pieces of each length a sequence holds."""
    left = {k: v for k, v in counts.items() if v > 0}
    out = []
    while left:
        top = max(left)
        left[top] -= 1
        pattern = closest(left, capacity - top)
        left[top] += 1
        pattern[top] = pattern.get(top, 0) + 1
        times = min(left[x] // k for x, k in pattern.items())
        for x, k in pattern.items():
            left[x] -= times * k
            if not left[x]:
                del left[x]
        out.append((times, pattern))
    return out


def placed(cut: DataFrame, capacity: int = CAPACITY, group_rows: int = 200_000) -> DataFrame:
    """`cut` (a stored table of pieces) with sequence_id and offset."""
    spark = cut.sparkSession
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    uses, used, sequence = [], dict.fromkeys(counts, 0), 0
    for times, pattern in plan(counts, capacity):
        offset = 0
        for length, k in sorted(pattern.items(), reverse=True):
            uses.append((length, used[length], used[length] + times * k, k, sequence, offset))
            used[length] += times * k
            offset += length * k
        sequence += times
    usage = spark.createDataFrame(uses, "u_length long, lo long, hi long, k long, seq long, off long")
    n_groups = max(64, -(-sum(counts.values()) // group_rows))
    grouped = cut.withColumn("_g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n_groups)))
    sums = grouped.groupBy("length", "_g").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_g")
    sums = sums.select(F.col("length").alias("_l"), F.col("_g").alias("_h"), (F.sum("n").over(before) - F.col("n")).alias("_base"))
    inside = Window.partitionBy("length", "_g").orderBy("doc_id", "start", "ids_crc32")
    ranked = grouped.withColumn("_r", F.row_number().over(inside) - 1).join(sums, (F.col("length") == F.col("_l")) & (F.col("_g") == F.col("_h")))
    ranked = ranked.withColumn("_rank", F.col("_r") + F.col("_base"))
    # the usage table follows from the lengths alone and stays small
    joined = ranked.join(F.broadcast(usage), (F.col("length") == F.col("u_length")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
    nth = F.col("_rank") - F.col("lo")
    return joined.select(*cut.columns, (F.col("seq") + F.floor(nth / F.col("k"))).alias("sequence_id"), (F.col("off") + (nth % F.col("k")) * F.col("length")).cast("long").alias("offset"))


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    return placed(stored(pieces(docs, tokenizer, capacity)), capacity)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer_path())

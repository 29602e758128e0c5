"""Importance resampling towards a target distribution of hashed n-grams.

The n-grams (1 to 3 words) of all texts and of all target texts are counted in buckets; a bucket's gain says how much
commoner it is in the target. A document's weight is the sum of the gains of its n-grams, and the documents with the highest
weights, each with noise of its own (Gumbel, from its id), are drawn: sampling without replacement by importance.

Inside a task the n-grams of a chunk of words are interned in an open-addressed table (`grams`): buckets are computed and
gains looked up once for each different n-gram, and the occurrences gather them by their slots. The first pass adds up the
counts of the buckets, of which n_buckets rows reach the driver; the second one adds up gains. Ranks come from one sort by
ranges: a row's rank is its place in its partition plus the sizes of the partitions before.

Nulls: a null text has no words; a null doc_id counts as empty in the noise and as larger than all others. Documents with
fewer than `min_words` words are never drawn. Repeated rows are weighed and drawn one by one; ties go to the smaller doc_id.
Very long texts and very long words are read whole, in chunks. An empty table, or one without a long enough document, draws
nothing; without target texts every gain comes from the smoothing alone. Columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .grams import tables
from .kernels import sliced, stored, table
from .units import column

N_BUCKETS = 10_000
SEED = 42
MIN_WORDS = 20


def bucket_counts(texts: DataFrame, n_buckets: int = N_BUCKETS) -> np.ndarray:
    """n-grams of all texts in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for _, data, at in sliced(batches):
            for t, _ in tables(data, at, n_buckets)[1]:
                np.add.at(total, t.bucket, t.count)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(n_buckets, np.int64)
    for r in texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most n_buckets rows
        out[r["bucket"]] = r["n"]
    return out


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the smoothed shares), as integers."""
    n, all_have, all_want = len(have), float(have.sum()), float(want.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_have + n) / ((s + 1) * (all_want + n)))) for s, t in zip(have.astype(float).tolist(), want.astype(float).tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in sliced(batches):
            n_words, chunks = tables(data, at, len(gain))
            weight, n = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
            for t, row in chunks:
                weight += np.bincount(row, weights=gain[t.bucket][t.slot], minlength=len(n)).astype(np.int64)  # sums of a chunk are exact in doubles
                n += np.bincount(row, minlength=len(n))
            yield pa.record_batch([column(rows, "doc_id"), pa.array(n_words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) with u from the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def with_ranks(rows: DataFrame, *order: Column) -> DataFrame:
    """`rows` with rank, from 1: sorted by ranges and stored, so that the sizes of partitions belong to the very rows they count."""
    place = F.monotonically_increasing_id()  # the partition in the upper bits, the place in it in the lower 33
    laid = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place))
    laid = laid.withColumn("_part", F.shiftright("_place", 33))
    sizes = sorted((r["_part"], r["n"]) for r in laid.groupBy("_part").agg(F.count("*").alias("n")).collect())  # one row a partition
    before, base = [], 0
    for part, n in sizes:
        before.append((part, base))
        base += n
    shift = rows.sparkSession.createDataFrame(before, "_part long, _base long")
    return laid.join(F.broadcast(shift), "_part").withColumn("rank", F.col("_base") + F.col("_place").bitwiseAND(F.lit(2**33 - 1)) + 1).drop("_place", "_part", "_base")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = MIN_WORDS, n_buckets: int = N_BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; rank is null where the row is not drawn."""
    gain = gains(bucket_counts(docs, n_buckets), bucket_counts(target, n_buckets))
    rows = stored(weighed(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    enough = rows.where(F.col("n_words") >= min_words)
    n_drawn = percent * enough.count() // 100
    ranked = with_ranks(enough, F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    drawn = ranked.withColumn("rank", F.when(F.col("rank") <= n_drawn, F.col("rank")))
    rest = rows.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A twentieth of all documents, drawn towards the benchmark texts."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

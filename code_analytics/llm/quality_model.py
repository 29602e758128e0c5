"""Quality classifier: regularised quadratic discriminant analysis over transformed statistics of the text.

The statistics of every whole text are counted once and stored. The two classes need only counts, sums and
products of the statistics over the labelled training rows; tasks add these up and Spark sums them, so all
training rows are used and what reaches the driver has a fixed size. Each class covariance is shrunk towards the diagonal
of the pooled one; the Cholesky factors are made once and sent with the means. The score is the logistic of the
difference of the log densities plus that of the priors.

Nulls: a null text counts as empty and gets a score; rows without id are never training rows and not held out; labels that
are null are left out. Repeated rows are scored alike; several labels of an id count one by one. With fewer than
two classes among the labels every score is 0.5. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import sliced, stored, table
from .units import Units, column

HELD_OUT = 2
SHRINK = 0.1
RIDGE = 1e-3
CUT = 0.7
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
KINDS = {"upper": range(65, 91), "digit": range(48, 58), "stop": [46, 44, 59, 58], "mark": [33, 63], "high": range(128, 256)}
MASKS = {k: np.isin(np.arange(256), list(v)) for k, v in KINDS.items()}
LETTERS = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text."""
    u = Units(data, at)
    n_rows = len(at) - 1
    size = np.diff(at)

    def per_row(values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1)
        np.cumsum(values, out=total[1:])
        return total[at[1:]] - total[at[:-1]]

    words = np.diff(u.upto)
    count = np.maximum(words, 1)
    letters = np.maximum(per_row(LETTERS[data]), 1)
    share = lambda x, y: np.arcsin(np.sqrt(np.clip(x / y, 0, 1)))
    length = (u.ends - u.starts).astype(float)
    sums = lambda v: np.bincount(u.row_of_word, weights=v, minlength=n_rows)
    mean = sums(length) / count
    spread = np.sqrt(np.maximum(sums(length**2) / count - mean**2, 0))
    same = np.zeros(len(u.codes))
    same[1:] = (u.codes[1:] == u.codes[:-1]) & (u.row_of_word[1:] == u.row_of_word[:-1])
    alike = np.lexsort((u.codes, u.row_of_word))
    fresh = np.ones(len(alike))
    fresh[1:] = (u.codes[alike][1:] != u.codes[alike][:-1]) | (u.row_of_word[alike][1:] != u.row_of_word[alike][:-1])
    distinct = np.bincount(u.row_of_word[alike], weights=fresh, minlength=n_rows)
    lines = np.maximum(np.bincount(u.row, minlength=n_rows), 1)
    bytes_ = np.maximum(size, 1)
    return np.column_stack(
        [
            np.log1p(words),
            np.log1p(mean),
            np.log1p(spread),
            np.log1p(words / lines),
            share(per_row(SYMBOLS[data]), bytes_),
            *(share(per_row(MASKS[k][data]), bytes_) for k in ("digit", "stop", "mark", "high")),
            share(per_row(MASKS["upper"][data]), letters),
            share(letters, bytes_),
            share(sums(same), count),
            np.log(np.maximum(distinct, 1)) / np.log(np.maximum(words, 2)),
        ]
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in sliced(batches):
            x = statistics(data, at)
            lists = pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(x.reshape(-1)))
            yield pa.record_batch([column(rows, "doc_id"), lists], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<double>")


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def matrix(lists: pa.Array, n: int) -> np.ndarray:
    flat = (lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def moments(labelled: DataFrame) -> dict[int, np.ndarray]:
    """For each class the sum of (1, x)(1, x)'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            x, y = matrix(column(b, "x"), b.num_rows), column(b, "y").to_numpy()
            z = np.column_stack([np.ones(len(x)), x])
            for c in np.unique(y).tolist():
                total[c] = total.get(c, 0) + z[y == c].T @ z[y == c]
        for c, m in total.items():
            yield pa.record_batch([pa.array(np.full(m.size, c, np.int32)), pa.array(np.arange(m.size, dtype=np.int32)), pa.array(m.reshape(-1))], ["y", "place", "v"])

    rows = labelled.select("y", "x").mapInArrow(run, "y int, place int, v double").groupBy("y", "place").agg(F.sum("v").alias("v")).collect()  # classes x (1 + d)^2 rows
    out: dict[int, np.ndarray] = {}
    for c in {r["y"] for r in rows}:
        v = [x["v"] for x in sorted((r for r in rows if r["y"] == c), key=lambda r: r["place"])]
        out[c] = np.array(v).reshape(int(len(v) ** 0.5), -1)
    return out


def fitted(sums: dict[int, np.ndarray], shrink: float = SHRINK) -> list[tuple[float, np.ndarray, np.ndarray]] | None:
    """(log prior, mean, Cholesky factor) of class 0 and 1."""
    if not {0, 1} <= set(sums):
        return None
    stats = {}
    for c, m in sums.items():
        n, mean = m[0, 0], m[0, 1:] / m[0, 0]
        stats[c] = (n, mean, m[1:, 1:] / n - np.outer(mean, mean))
    total = sum(s[0] for s in stats.values())
    pooled = np.diag(sum(s[0] * s[2] for s in stats.values())) / total
    out = []
    for c in (0, 1):
        n, mean, cov = stats[c]
        out.append((float(np.log(n / total)), mean, np.linalg.cholesky((1 - shrink) * cov + shrink * np.diag(pooled) + RIDGE * np.eye(len(mean)))))
    return out


def scores(model: list[tuple[float, np.ndarray, np.ndarray]] | None, x: np.ndarray) -> np.ndarray:
    if model is None or not len(x):
        return np.full(len(x), 0.5)
    log = []
    for prior, mean, factor in model:
        z = np.linalg.solve(factor, (x - mean).T)
        log.append(prior - 0.5 * (z**2).sum(axis=0) - np.log(np.diag(factor)).sum())
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    x = stored(with_statistics(docs))
    train = x.where(~held_out()).join(labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("y")), "doc_id")
    model = fitted(moments(train))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([column(b, "doc_id"), column(b, "held_out"), pa.array(scores(model, matrix(column(b, "x"), b.num_rows)))], ["doc_id", "held_out", "score"])

    out = x.select("doc_id", held_out().alias("held_out"), "x").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

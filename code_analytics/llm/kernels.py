"""Vectorised helpers that run inside tasks, and the two Spark helpers all operators share.

Texts reach a task as Arrow columns; the helpers look at their UTF-8 bytes as one array and never build
Python strings for single words. Work is cut into slices of about a megabyte so that memory stays flat
whatever the size of a record batch; a longer text is a slice of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 20
U = np.uint64


def _mixed(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return x ^ (x >> 31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


_STEP = U(_mixed(7) | 1)
_BACK = U(pow(int(_STEP), -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd constant and of its inverse, 0 to n."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_STEP, _BACK)):
            out = np.full(max(n + 1, 1 << 21), base, U)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


BYTE_CODE = np.array([_mixed(b + 1000) for b in range(256)], U)
#: A to Z count as a to z.
LOWER_CODE = BYTE_CODE.copy()
LOWER_CODE[65:91] = BYTE_CODE[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their bytes, offsets) in slices of about SLICE_BYTES."""
    for batch in batches:
        data, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE_BYTES, "right")) - 1)
            yield batch.slice(lo, hi - lo), data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            lo = hi


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that don't cross a row, and the offsets of rows among them."""
    n = len(inside)
    first = np.zeros(n + 1, bool)
    first[at] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_codes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each span [start, end) of a coded array."""
    up, down = powers(len(codes))
    total = np.zeros(len(codes) + 1, U)
    np.cumsum(codes * up[: len(codes)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def words(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digest, start and end of every word (bytes other than white space), and the offsets of rows among them."""
    starts, ends, rows = runs(~IS_SPACE[data], at)
    return span_codes((LOWER_CODE if lower else BYTE_CODE)[data], starts, ends), starts, ends, rows


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Digest of each k codes in a row; shorter by k - 1."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = codes[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += codes[j : j + n]
    return mix(out)


def shingle_sets(codes: np.ndarray, rows: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each row; with fewer words the whole sequence, without any none."""
    every = grams(codes, k)
    out = []
    for lo, hi in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if hi - lo >= k:
            out.append(np.unique(every[lo : hi - k + 1]))
        elif hi > lo:
            out.append(mix(grams(codes[lo:hi], hi - lo) + U(hi - lo)))
        else:
            out.append(np.zeros(0, U))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or, where the session names none, one in the warehouse.

    A warehouse of one machine will do in local mode only; on a cluster it is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("tables between steps need spark.checkpoint.dir: the warehouse lies on one machine")
    return f"{warehouse}/_shared"


_stored: list[str] = []


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """df written as a table (in folders by a column) into the shared folder and read again: the lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    _stored.append(path)
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_so_far() -> int:
    return len(_stored)


def drop_stored(spark: SparkSession, since: int = 0, keep_last: bool = False) -> None:
    """Deletes the tables that this driver has stored since then, or all but the last. Results that are not written yet need theirs."""
    kept = _stored[-1:] if keep_last else []
    gone, _stored[since:] = [p for p in _stored[since:] if p not in kept], kept
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

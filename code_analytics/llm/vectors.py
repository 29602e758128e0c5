"""What the vector operators share: usable vectors as matrices, and a join that splits hot keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: a key with more than one in so many rows is hot, so there are fewer hot keys than that
HOT_SHARE = 1_000


def finite(vector: str = "embedding") -> Column:
    """Whether a vector is there, has components, and all of them are finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & good, F.lit(False))


def dimensions(vectors: DataFrame, key: str = "vec_id") -> int:
    """The number of components of the finite vector with the smallest key, 0 where there is none; vectors of other lengths can't be compared with it."""
    first = vectors.where(finite()).orderBy(F.col(key).asc_nulls_last(), F.size("embedding")).select(F.size("embedding").alias("n")).first()
    return first["n"] if first else 0


def matrix(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that are vectors of n finite components, and their components."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    right = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), n), False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False)  # a null component is NaN
    x = np.asarray(flat, np.float64 if flat.dtype == np.float64 else np.float32).reshape(len(right), n)
    good = np.isfinite(x).all(axis=1)
    return right[good], x[good]


def joined_by_hot_keys(rows: DataFrame, values: DataFrame, key: str, n_rows: int, weight: str) -> DataFrame:
    """`rows` joined with `values` (one row a key, `weight` its number of rows): hot keys by a broadcast of fewer than HOT_SHARE rows, the others by a shuffle."""
    hot = values.where(F.col(weight) * HOT_SHARE > n_rows)
    cold = values.where(F.col(weight) * HOT_SHARE <= n_rows)
    few = F.broadcast(hot)
    return rows.join(few, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))

"""Lines and sentences of whole columns as runs of words, and rows rewritten without some of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import span_codes, words

LAST_SIGNS = np.zeros(256, bool)
LAST_SIGNS[[ord(c) for c in ".!?"]] = True


def second(codes: np.ndarray) -> np.ndarray:
    """Codes of the same words for the second of two digests."""
    return (codes >> np.uint64(7)) * codes


class Units:
    """The words of the rows, and units as half-open word ranges [first, stop), each inside one line."""

    def __init__(self, data: np.ndarray, at: np.ndarray, sentences: bool = False):
        self.data, self.at = data, at
        self.codes, self.starts, self.ends, self.upto = words(data, at)
        n = len(self.codes)
        self.row_of_word = np.repeat(np.arange(len(at) - 1), np.diff(self.upto))
        breaks = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data == 10, out=breaks[1:])
        self.line_of_word = breaks[self.starts] - breaks[at[:-1]][self.row_of_word] if n else np.zeros(0, np.int64)
        new = np.ones(n, bool)
        new[1:] = (self.line_of_word[1:] != self.line_of_word[:-1]) | (self.row_of_word[1:] != self.row_of_word[:-1])
        if sentences and n:
            new[1:] |= LAST_SIGNS[data[self.ends[:-1] - 1]]
        self.first = np.flatnonzero(new)
        self.stop = np.append(self.first[1:], n)[: len(self.first)]

    def pick(self, keep: np.ndarray) -> None:
        self.first, self.stop = self.first[keep], self.stop[keep]

    @property
    def n_words(self) -> np.ndarray:
        return self.stop - self.first

    @property
    def row(self) -> np.ndarray:
        return self.row_of_word[self.first] if len(self.first) else np.zeros(0, np.int64)

    @property
    def line(self) -> np.ndarray:
        return self.line_of_word[self.first] if len(self.first) else np.zeros(0, np.int64)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent digests of each unit's words, so that white space and A-Z / a-z make no difference."""
        if not len(self.codes):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return span_codes(self.codes, self.first, self.stop), span_codes(second(self.codes), self.first, self.stop)

    def chars(self) -> tuple[np.ndarray, np.ndarray]:
        """Offset and length of each unit in characters of its row's text."""
        upto = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=upto[1:])
        if not len(self.first):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo, hi = self.starts[self.first], self.ends[self.stop - 1]
        return upto[lo] - upto[self.at[self.row]], upto[hi] - upto[lo]


#: A row is known by its id and a hash of its text, so that rows which share an id are told apart.
def ord_of(c: str = "doc_id") -> Column:
    return F.coalesce(F.col(c).cast("long"), F.lit(2**63 - 1))


def key_of() -> Column:
    """A digest of the text: 128 bits where it alone tells a row from others, which is without an id, and 64 beside an id."""
    text = F.coalesce("text", F.lit(""))
    return F.when(F.col("doc_id").cast("long").isNull(), F.unhex(F.md5(text))).otherwise(F.unhex(F.lpad(F.hex(F.xxhash64(text)), 16, "0")))


def keyed(docs: DataFrame) -> DataFrame:
    """ord, k and text; a null id counts as larger than all others."""
    return docs.select(ord_of().alias("ord"), key_of().alias("k"), "text")


def column(rows: pa.RecordBatch, name: str) -> pa.Array:
    return rows.column(rows.schema.get_field_index(name))

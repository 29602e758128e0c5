"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next stage's docs;
all but the last return the columns of `documents`, further columns and their names included.

Nulls, empty and very long texts, ties and repeated rows are handled by each stage as its operator says: a null text fails
the quality rules; equal rows are judged alike and stay or go together, except that near duplicates keep all rows that
are equal in id and text. An empty table passes through every stage and gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from code_analytics.llm import decontamination, line_dedup, near_dups, packing, quality_rules
from code_analytics.llm.kernels import drop_stored, stored, stored_so_far, table


#: word shingles shared by near copies, of all their shingles
NEAR_PERCENT = 80


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filtered(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeats(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.one_of_each(docs, NEAR_PERCENT)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, packing.tokenizer_path())


STAGES = [("quality rules", rules), ("line dedup", lines), ("near duplicates", near), ("decontamination", benchmark), ("packing", pack)]

#: tokens, sketches and fingerprints have no SQL; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), stored_so_far()
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        drop_stored(spark, since, keep_last=True)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import passage_dedup, quality_rules, vector_codes
from .decontamination import op9_decontamination
from .line_dedup import op2_line_dedup
from .lm_scoring import op5_lm_scoring
from .near_dups import op4_near_dups
from .packing import op1_packing
from .passage_dedup import op6_passage_dedup
from .quality_model import op7_quality_model
from .quality_rules import op3_quality_rules
from .resampling import op12_resampling
from .sharding import op8_sharding
from .suffix_dedup import op10_suffix_dedup
from .vector_codes import op13_vector_codes
from .vector_search import op11_neighbours


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_near_dups": op4_near_dups,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_passage_dedup": op6_passage_dedup,
    "op7_quality_model": op7_quality_model,
    "op8_sharding": op8_sharding,
    "op9_decontamination": op9_decontamination,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_neighbours": op11_neighbours,
    "op12_resampling": op12_resampling,
    "op13_vector_codes": op13_vector_codes,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": quality_rules.ORACLE,
    "op6_passage_dedup": passage_dedup.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}

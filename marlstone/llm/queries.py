"""Queries of the numbered operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.codebooks import OP13_SQL, op13_vector_codes
from marlstone.llm.decontamination import OP7_SQL, op7_decontamination
from marlstone.llm.infill import OP11_SQL, op11_infill
from marlstone.llm.interpolation import op9_lm_scores
from marlstone.llm.jaccard import op4_jaccard_join
from marlstone.llm.language import op3_language
from marlstone.llm.lines import OP5_SQL, op5_line_dedup
from marlstone.llm.packing import op1_packing
from marlstone.llm.pivots import OP12_SQL, op12_top_k
from marlstone.llm.quality import op8_quality
from marlstone.llm.repair import op2_token_ids
from marlstone.llm.toxicity import op6_toxicity
from marlstone.llm.warc import OP10_SQL, op10_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_token_ids": op2_token_ids,
        "op3_language": op3_language,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_line_dedup": op5_line_dedup,
        "op6_toxicity": op6_toxicity,
        "op7_decontamination": op7_decontamination,
        "op8_quality": op8_quality,
        "op9_lm_scores": op9_lm_scores,
        "op10_warc": op10_warc,
        "op11_infill": op11_infill,
        "op12_top_k": op12_top_k,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": OP5_SQL, "op7_decontamination": OP7_SQL, "op10_warc": OP10_SQL, "op11_infill": OP11_SQL, "op12_top_k": OP12_SQL, "op13_vector_codes": OP13_SQL}

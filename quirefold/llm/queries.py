"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirefold.llm import bpe, decontaminate, exact_dedup, html_extract, jaccard_join, quality, sharding, substring_dedup, token_file, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_sharding": sharding.op2_sharding,
        "op3_html_extract": html_extract.op3_html_extract,
        "op4_bpe": bpe.op4_bpe,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_token_file": token_file.op6_token_file,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_quality": quality.op8_quality,
        "op9_jaccard_join": jaccard_join.op9_jaccard_join,
        "op10_decontaminate": decontaminate.op10_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.OP1_SQL, "op5_substring_dedup": substring_dedup.OP5_SQL, "op10_decontaminate": decontaminate.OP10_SQL}

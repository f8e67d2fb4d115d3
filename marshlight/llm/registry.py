"""The training-data operators' queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marshlight.llm import op1_line_dedup, op4_sharding, op7_exact_dedup, op8_top_k, op11_repair, op12_trie
from marshlight.llm.op2_near_dedup import op2_near_dedup
from marshlight.llm.op3_packing import op3_packing
from marshlight.llm.op5_toxicity import op5_toxicity
from marshlight.llm.op6_quality import op6_quality
from marshlight.llm.op9_bpe import op9_bpe
from marshlight.llm.op10_token_files import op10_token_files
from marshlight.llm.op13_language import op13_language


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup.op1_line_dedup,
        "op2_near_dedup": op2_near_dedup,
        "op3_packing": op3_packing,
        "op4_sharding": op4_sharding.op4_sharding,
        "op5_toxicity": op5_toxicity,
        "op6_quality": op6_quality,
        "op7_exact_dedup": op7_exact_dedup.op7_exact_dedup,
        "op8_top_k": op8_top_k.op8_top_k,
        "op9_bpe": op9_bpe,
        "op10_token_files": op10_token_files,
        "op11_repair": op11_repair.op11_repair,
        "op12_trie": op12_trie.op12_trie,
        "op13_language": op13_language,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": op1_line_dedup.ORACLE,
        "op4_sharding": op4_sharding.ORACLE,
        "op7_exact_dedup": op7_exact_dedup.ORACLE,
        "op8_top_k": op8_top_k.ORACLE,
        "op11_repair": op11_repair.ORACLE,
        "op12_trie": op12_trie.ORACLE,
    }

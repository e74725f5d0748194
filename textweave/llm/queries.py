"""Queries and SQL of the training-data operators, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textweave.llm.decontaminate import op3_decontaminate
from textweave.llm.line_dedup import OP5_SQL, op5_line_dedup
from textweave.llm.minhash_dedup import op1_minhash_dedup
from textweave.llm.mixing import op4_mixing
from textweave.llm.nearest import op10_nearest
from textweave.llm.pii import op2_pii
from textweave.llm.secrets import op9_secrets
from textweave.llm.sharding import op6_sharding
from textweave.llm.token_counts import op8_token_counts
from textweave.llm.toxicity import op7_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_pii": op2_pii,
    "op3_decontaminate": op3_decontaminate,
    "op4_mixing": op4_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_sharding": op6_sharding,
    "op7_toxicity": op7_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_secrets": op9_secrets,
    "op10_nearest": op10_nearest,
}
ORACLE_SQL: dict[str, str] = {"op5_line_dedup": OP5_SQL}

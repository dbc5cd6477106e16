"""Operators for training-data pipelines, one module each; QUERIES and ORACLES hold their jobs."""

from stforecast.llm import (
    exact_dedup,
    exact_topk,
    fill_middle,
    hard_negatives,
    lang_id,
    line_dedup,
    mixing,
    near_dedup,
    packing,
    page_text,
    quality_rules,
    sharding,
    token_files,
)
from stforecast.llm.shared import ORACLES, QUERIES

__all__ = [
    "ORACLES", "QUERIES", "exact_dedup", "exact_topk", "fill_middle", "hard_negatives", "lang_id", "line_dedup", "mixing",
    "near_dedup", "packing", "page_text", "quality_rules", "sharding", "token_files",
]

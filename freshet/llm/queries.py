"""The corpus operators applied to the driver's tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from freshet.llm import curriculum, decontaminate, huffman, language, line_dedup, near_dedup, packing, prefix_trie, quality, repetition, suffix_dedup, token_counts, whitening

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

for _module in (curriculum, line_dedup, decontaminate, repetition, quality, near_dedup, language, token_counts, huffman, suffix_dedup, whitening, prefix_trie, packing):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES

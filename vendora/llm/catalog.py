"""All queries of this subpackage."""

from __future__ import annotations

from vendora.llm import (  # noqa: F401  (they register their queries)
    decontaminate, html_template, jaccard_trie, kneser_ney, line_dedup, ppm, quality_lines,
    merkle, phrases, sentencepiece_bpe, token_rollup, toxicity, warc)
from vendora.llm.registry import ORACLES, QUERIES


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict:
    return ORACLES

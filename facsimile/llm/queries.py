"""All queries of this subpackage (the imports register them)."""

from __future__ import annotations

from . import bloom_lm, decontaminate, hard_negatives, html_text, langid, maxscore, pii, quality_rules, sentencepiece_scan, sharding, simhash, toxicity, warc  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Imports every operator, so that its query is registered."""
from auditframe.llm import (  # noqa: F401
    bpe, chat, decontaminate, exact_dedup, fill_middle, filter_audit, line_dedup, lm, ngram_join, pii, quality, secrets, toxicity,
)
from auditframe.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

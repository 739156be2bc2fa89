"""Registry of the corpus queries."""

from __future__ import annotations

from . import chat_format, compression_quality, decontamination, line_dedup, near_dedup, quality_rules, sentencepiece_fst, token_counts, toxicity, url_filter

_MODULES = (chat_format, url_filter, decontamination, line_dedup, near_dedup, quality_rules, sentencepiece_fst, token_counts, toxicity, compression_quality)


def queries():
    return {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}


def oracle_sql():
    found = {name: sql for module in _MODULES for name, sql in getattr(module, "ORACLES", {}).items()}
    return {name: sql if isinstance(sql, str) else sql() for name, sql in found.items()}

"""The corpus operators' queries and SQL, by name."""

from __future__ import annotations

from evidra.llm import click_dedup, decontam, exact_dedup, html_text, language, lexical, near_dedup, passages, personal, pieces, quality, token_counts, token_files

MODULES = (token_counts, language, passages, pieces, html_text, exact_dedup, quality, decontam, token_files, near_dedup, click_dedup, personal, lexical)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in vars(m).items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}

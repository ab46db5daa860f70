"""Queries and SQL of the subpackage, by name."""

from __future__ import annotations

from . import chat, decontaminate, language_id, mixing, near_dup, quality_rules, secrets, sentence_spans, sharding, toxicity

MODULES = (sharding, secrets, toxicity, quality_rules, decontaminate, language_id, mixing, chat, near_dup, sentence_spans)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}

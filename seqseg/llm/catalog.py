"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("q_rules", "q_chat", "q_matching", "q_scans", "q_tokens", "q_models", "q_trie", "q_phrases")


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(getattr(import_module(f"seqseg.llm.{name}"), attribute))
    return found


QUERIES = _collect("QUERIES")
ORACLES: dict[str, str] = _collect("ORACLES")

"""The modules that register queries; each has QUERIES and SQL."""

from __future__ import annotations

import importlib

NAMES = ("sentencepiece", "pii", "chat", "warc", "quality_rules", "quality_classifier", "mixing", "simhash", "suffix_dedup", "embedding_dedup", "whitening", "token_ids", "hard_negatives")


def modules() -> list:
    return [*(importlib.import_module(f"proxigraph.llm.{n}") for n in NAMES), importlib.import_module("corpus_pipeline")]

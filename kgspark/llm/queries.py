"""Imports every corpus query, so that the registry is full."""

import importlib

from kgspark.llm.registry import QUERIES

MODULES = ("q01_sentence_piece", "q02_mixing", "q03_language_id", "q04_license_scan", "q05_line_dedup", "q06_token_file",
           "q07_token_counts", "q08_jaccard_join", "q09_exact_dedup",
           "q10_topk_search", "q11_trie_bpe", "q12_spelling_variants", "q13_collocations")


def load() -> dict:
    for module in MODULES:
        importlib.import_module(f"kgspark.llm.{module}")
    return QUERIES

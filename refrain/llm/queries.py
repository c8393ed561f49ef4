"""All queries of the folder: importing the operator modules registers them."""

from __future__ import annotations

from refrain.llm import decontaminate, exact_dedup, hard_negatives, line_dedup, lm_score, mixing, personal_data, prefix_trie, quality, simhash, suffix_dedup, token_output, url_rules  # noqa: F401
from refrain.llm.registry import ORACLES, QUERIES  # noqa: F401

"""Importing this module registers the subpackage's queries."""

from wattle.llm import chosen_path, entropy_mix, html_text, lpt_shards, multiset_hash, ordinal_toxicity, periodic_runs, quotient_dedup, reversed_search, secret_linking, sentencepiece_codec, token_files, url_vocabulary  # noqa: F401
from wattle.llm.registry import ORACLES, QUERIES  # noqa: F401

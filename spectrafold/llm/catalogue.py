"""Importing this fills the registry with every query of the subpackage."""

from . import (  # noqa: F401
    conversation_repair,
    conversation_trie,
    embedding_dedup,
    exact_dedup,
    html_extract,
    license_scan,
    line_dedup,
    ngram_join,
    packing,
    quality,
    secret_scan,
    source_mix,
    toxicity,
)
from .registry import ORACLES, QUERIES  # noqa: F401

"""All queries of this subpackage, and their SQL."""

from __future__ import annotations

from . import (  # noqa: F401
    chat, lexical, licenses, mixing, order_minhash, packing, repetition, simhash, suffix_tree, token_counts,
    topk_search, toxicity, whitening,
)
from .common import QUERIES, SQL  # noqa: F401

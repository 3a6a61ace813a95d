"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import exact_dedup, mixing, pii, piece_coding, prefix_trie, quality, sharding, simhash, token_counts, topk, toxicity, url_rules, whitening

_MODULES = (token_counts, topk, mixing, quality, sharding, toxicity, piece_coding, simhash, pii, exact_dedup, url_rules, whitening, prefix_trie)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}

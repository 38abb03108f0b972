"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import avi, bpe, contamination, language_id, near_dup, quality, repeats, token_counts, url_filter

MODULES = [near_dup, repeats, bpe, avi, token_counts, language_id, contamination, url_filter, quality]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: f for m in MODULES for k, f in m.SQL.items()}

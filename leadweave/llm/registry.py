"""Queries of this subpackage, and their SQL where there is some."""

from __future__ import annotations

from leadweave.llm import exact_dedup, html_extraction, jaccard_join, mixing, packing, pii, quality, runs, sharding, substring_dedup, topk, url_filter, whitening

MODULES = (packing, url_filter, exact_dedup, topk, sharding, mixing, quality, pii, substring_dedup, jaccard_join, html_extraction, runs, whitening)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}

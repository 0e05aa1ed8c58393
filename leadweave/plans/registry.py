"""Queries of the library, and their SQL."""

from __future__ import annotations

from leadweave.plans import documents, pages, records, rules, tables

MODULES = (pages, documents, tables, rules, records)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}

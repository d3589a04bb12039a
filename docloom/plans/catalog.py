"""Collects the named plans of the engine and their SQL."""

from __future__ import annotations

from docloom.plans import crawling, series, streams, texts, urls

MODULES = (urls, crawling, texts, series, streams)
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}

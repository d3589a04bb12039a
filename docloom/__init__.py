"""docloom: a PySpark-native engine for evidence-backed document corpora.

The names of ``__all__`` are loaded from their modules when they are first used.
"""

from importlib import import_module

__version__ = "0.1.0"
_PLACES = {
    "docloom.functions.urls": ("accession_number", "content_hash", "convert_to_https", "extract_domain", "is_same_document", "is_valid_url", "normalize_url", "robots_url", "url_hash"),
    "docloom.functions.text": ("ai_label", "document_type", "evidence", "evidence_all", "html_text", "product_label", "publish_date", "quality_reasons", "risk_label", "sentences"),
    "docloom.sources.domains": ("DOMAINS", "PRIORITY", "SOURCE_TYPES", "all_domains", "by_priority", "by_source_type", "lookup"),
    "docloom.sources.fetch": ("fetch", "filing_headers", "merged", "robots_files", "robots_headers", "session", "session_headers", "with_retry"),
    "docloom.operators.crawl": ("adaptive_rates", "backoff", "cache_stats", "daily_cap", "fresh", "parse_robots", "plan", "robots_verdicts", "schedule"),
    "docloom.operators.dedup": ("canonical_map", "first_seen", "seen", "unseen", "upsert"),
    "docloom.operators.features": ("as_of", "lagged", "leakage", "with_labels"),
    "docloom.operators.graph": ("canonical", "co_mentions", "edges", "mentions"),
    "docloom.streaming.jobs": ("cached", "rate_state"),
}
_WHERE = {name: module for module, names in _PLACES.items() for name in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(_WHERE[name]), name)

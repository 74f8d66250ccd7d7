"""Structured Streaming forms of parsing and counting."""

from lumenlog.streaming.flows import new_templates, parse_stream, tumbling_counts, upsert_counts

__all__ = ["new_templates", "parse_stream", "tumbling_counts", "upsert_counts"]

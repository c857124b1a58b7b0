"""Structured Streaming: debounced changes, staleness gates, enrichment triggers."""

"""Whole plans: extraction, pattern search, the store, the tools and the query catalogue."""

"""Incremental merges with Structured Streaming."""

"""Incremental search and counts on Structured Streaming."""

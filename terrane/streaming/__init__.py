"""Incremental operation over append-only tables with Structured Streaming."""

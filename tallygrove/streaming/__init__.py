"""Incremental audits with Structured Streaming."""

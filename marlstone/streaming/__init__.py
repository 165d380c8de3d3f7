"""Structured Streaming forms of incremental steps."""

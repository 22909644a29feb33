"""Structured Streaming forms of the log-shaped operators."""

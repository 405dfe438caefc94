"""Structured Streaming forms of the host checks."""

"""Structured Streaming forms of the sources."""

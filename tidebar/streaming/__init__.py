"""Structured Streaming forms of the landing and logging steps."""

"""Readers that shape raw files into model tables, and table sinks."""

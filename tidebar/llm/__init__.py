"""Operators for building training corpora, their queries and check SQL. Nothing else in the library imports this."""

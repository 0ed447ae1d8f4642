"""Window, join, aggregate, set and statistics operators."""

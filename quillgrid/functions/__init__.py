"""Column functions and query-term helpers."""

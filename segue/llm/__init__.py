"""Operators for preparing training data: one module each, queries and SQL beside them."""

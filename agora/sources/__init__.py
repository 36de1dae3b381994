"""Readers: given tables, fixture mapping onto the commerce schema, files."""

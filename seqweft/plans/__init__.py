"""Queries over the driver's tables: each applies library operators, beside the same query in plain SQL."""

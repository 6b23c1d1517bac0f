"""Compositions, derived tables and the query registry."""

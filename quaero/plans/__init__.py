"""Registered queries with their DuckDB counterparts."""

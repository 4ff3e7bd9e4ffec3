"""Relational building blocks: fixpoints, range and as-of joins, searches."""

"""Canonical tables over the given data, named queries and their SQL twins."""

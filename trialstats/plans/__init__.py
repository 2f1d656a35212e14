"""Composed analyses, the registry of queries over plain tables, and their SQL counterparts."""

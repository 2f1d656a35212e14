"""Readers and writers: per-subject logs, parquet facts, wide exports, and role views of plain tables."""

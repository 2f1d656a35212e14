"""Column-level functions: strict aggregates, recoding, text, and distribution functions."""

"""DataFrame operators. Each takes a DataFrame, its key columns, and returns a DataFrame."""

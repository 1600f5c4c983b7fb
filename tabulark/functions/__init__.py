"""Column expressions: missing values, stable hashes, text and cost functions."""

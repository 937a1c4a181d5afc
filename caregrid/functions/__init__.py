"""Column functions: casts, labels, text patterns."""

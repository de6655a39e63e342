"""Column expressions: hashing, comparison, severity, periods."""

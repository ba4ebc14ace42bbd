"""Column expressions: arithmetic, casts, text, map classes and code labels."""

"""Column functions: SQL text, names, sizes, rates and messages."""

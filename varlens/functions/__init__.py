"""Column functions: wire formats and write policy."""

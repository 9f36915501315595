"""Variable-store analytics on Spark."""

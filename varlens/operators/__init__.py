"""Operators over mutation logs, live state and images."""

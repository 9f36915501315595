"""Derived relations that queries start from."""

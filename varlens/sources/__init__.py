"""Readers of store images."""

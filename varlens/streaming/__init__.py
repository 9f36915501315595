"""Incremental replay."""

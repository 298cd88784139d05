"""Incremental loads and event streams."""

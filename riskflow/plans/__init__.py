"""Composed pipelines (what users call)."""

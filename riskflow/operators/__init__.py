"""Reusable DataFrame operators (all built from DataFrame / SQL built-ins)."""

"""Relational operators of the core engine."""

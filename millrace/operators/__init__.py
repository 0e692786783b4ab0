"""Relational operators as DataFrame helpers."""

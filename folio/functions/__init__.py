"""Expressions compiled to columns."""

"""Parsing and rewriting of pipelines."""

"""Pipelines and expiry over streams."""

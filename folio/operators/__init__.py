"""Filters, projections, stages, accumulators and updates as DataFrame operations."""

"""Training-data operators: filtering, deduplication, decontamination, formatting and packing.

Nothing else in the library imports this subpackage, and it imports nothing from the rest.
"""

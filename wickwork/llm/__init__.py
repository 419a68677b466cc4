"""Training-data operators: search, privacy, tokenising, packing, dedup, filters and scoring.

Nothing else in the library imports this subpackage.
"""

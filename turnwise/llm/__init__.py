"""Training-data operators: scoring, classifiers, near-duplicate joins, search, token counts and packing.

Nothing outside this subpackage imports it.
"""

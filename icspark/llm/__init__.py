"""Training-data operators: near-duplicates, repeated text, quality, extraction, packing.

Nothing outside this subpackage imports it.
"""

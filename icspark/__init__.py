"""Integrity-constrained, model-aware analytics on Spark DataFrames."""

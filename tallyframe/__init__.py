"""Probabilistic frame analytics on Spark DataFrames."""

"""Operators for large training-text corpora, each one a function from DataFrame to DataFrame."""

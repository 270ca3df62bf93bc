"""Column expressions: boxes, probability and text."""

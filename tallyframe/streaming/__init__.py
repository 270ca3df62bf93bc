"""Frames as a stream."""

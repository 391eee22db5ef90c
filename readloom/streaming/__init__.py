"""Counts over reads that arrive as a stream."""

"""Operators of a training-data pipeline: extraction, duplicates, scoring, tokens, leaks, secrets."""

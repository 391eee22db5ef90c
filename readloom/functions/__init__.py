"""Column expressions: sequences, relationship codes, statistics."""

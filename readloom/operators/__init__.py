"""Relational operators over reads, positions, profiles and structures."""

"""Whole steps: filtering, clustering, pooling, joining, scanning for domains."""

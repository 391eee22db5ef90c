"""Mutational profiling of sequencing reads as Spark DataFrame operations."""

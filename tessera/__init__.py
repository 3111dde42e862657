"""Strict SQL dialect, spatial, text and vector search on Spark."""

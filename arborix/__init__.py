"""Explainable hybrid retrieval over typed graphs, as DataFrame operations."""

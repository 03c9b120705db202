"""Whole jobs: searching and indexing."""

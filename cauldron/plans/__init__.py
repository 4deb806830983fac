"""Composed plans: the query registry and the end-to-end pipeline."""

"""Structured Streaming forms of the loader and the scorer."""

"""Relational and domain operators over the customer table."""

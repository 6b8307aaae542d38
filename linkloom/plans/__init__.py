"""Queries and end-to-end plans."""

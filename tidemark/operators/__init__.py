"""Operators of the data-quality library."""

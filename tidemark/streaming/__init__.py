"""Streaming of the data-quality library."""

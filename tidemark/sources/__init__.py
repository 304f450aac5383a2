"""Sources of the data-quality library."""

"""Plans of the data-quality library."""

"""Functions of the data-quality library."""

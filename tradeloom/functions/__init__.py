"""See the package docstring of tradeloom."""

"""Column builders and scalar functions."""

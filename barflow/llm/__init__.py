"""Operators of large-scale training-data preparation; nothing else in barflow imports this subpackage."""

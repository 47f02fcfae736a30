"""Readers: panels of bars from tables, and delimited price files."""

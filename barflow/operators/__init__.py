"""Dataframe operators on panels of bars."""

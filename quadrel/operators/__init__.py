"""Operators on DataFrames, by subject."""

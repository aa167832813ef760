"""Relational operators of the research library, each a function from DataFrames to a DataFrame."""

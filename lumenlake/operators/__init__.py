"""Operators: each takes DataFrames of signals and returns a DataFrame."""

"""Operators from DataFrames to a DataFrame, one module per family."""

"""Operators: pure functions from DataFrames to DataFrames, every parameter explicit."""

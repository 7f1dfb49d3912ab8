"""Operators of the catalog: DataFrames in, DataFrames out."""

"""Operators: each function takes and returns DataFrames."""

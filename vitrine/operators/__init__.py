"""Operators: every one takes DataFrames and returns a lazy DataFrame."""
